"""Column functions: names, scales, indicators, ranges. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decay times in seconds by indicator variant, the recording-folder pattern, the reference field of view.
TAU_S = {"6f": 0.7, "6m": 1.0, "6s": 1.5, "7f": 0.7, "8f": 0.15, "8m": 0.25, "8s": 0.5}
RECORDING = r"\d{4}-\d{2}-\d{2}_\d+(?:\+\d{4}-\d{2}-\d{2}_\d+)*"
FIELD_UM = 3080.90169
# The indicator's variant in a label, and the steps of a scale bar: up to 1.5, 3.5 and 7.5 of a power of ten
# it is 1, 2 and 5 of it, else 10.
VARIANT = r"(?i)gcamp\s*([678][fms])(?![A-Za-z0-9])"
BAR_STEPS = ((1.5, 1), (3.5, 2), (7.5, 5))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recording_of(path: Column | str) -> Column:
    """The innermost folder of a path that is named like a recording; NULL without one."""
    parts = F.filter(F.split(F.regexp_replace(_col(path), r"\\", "/"), "/"), lambda p: p.rlike(f"^{RECORDING}$"))
    return F.try_element_at(parts, F.lit(-1))


def trailing_index(path: Column | str) -> Column:
    """The last run of digits of a file's stem; -1 without one. Over 18 digits it is null, and such files sort by name."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"(\d+)\D*$", 1)
    return F.when(digits == "", F.lit(-1)).otherwise(digits.try_cast("long"))


def is_filtered(prefix: Column | str) -> Column:
    return F.array_contains(F.split(_col(prefix), "_"), "filtered")


def tau(label: Column | str, fallback: str = "8m") -> Column:
    """Decay time of an indicator's label by the variant after its family name; the fallback's otherwise."""
    code = F.lower(F.regexp_extract(F.coalesce(_col(label), F.lit("")), VARIANT, 1))
    known = F.create_map(*(F.lit(x) for kv in TAU_S.items() for x in kv))
    return F.coalesce(F.try_element_at(known, code), F.lit(TAU_S[fallback]))


def um_per_px(direct: Column | str, zoom: Column | str, width: Column | str, stored: Column | str, field_um: float = FIELD_UM) -> Column:
    """First positive of: the direct value, field / zoom / width, the stored value; else NULL."""
    positive = lambda c: F.when(_col(c) > 0, _col(c))
    return F.coalesce(positive(direct), F.lit(field_um) / positive(zoom) / positive(width), positive(stored))


def bar_length(span: Column | str, share: float = 0.2) -> Column:
    """A scale bar of 1, 2, 5 or 10 times a power of ten, near a share of the span; NULL for no positive span."""
    raw = F.when(_col(span) > 0, _col(span) * F.lit(share))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    length = F.when(raw.isNotNull(), power * 10)
    for below, times in reversed(BAR_STEPS):
        length = F.when(raw / power < below, power * times).otherwise(length)
    return length


def event_label(start: Column | str, end: Column | str) -> Column:
    """A window as part of a file name: points become 'p'."""
    return F.replace(F.format_string("%.2f-%.2fs", _col(start), _col(end)), F.lit("."), F.lit("p"))


def scratch_verdict(free: Column | str, needed: Column | str, pending: Column | str, margin: float) -> Column:
    """'ok' with room, 'wait' while pending work may free some, else 'fail'; unknown room is 'ok'."""
    room = _col(free).isNull() | (_col(free) >= _col(needed) + F.lit(margin))
    return F.when(room, "ok").when(_col(pending) > 0, "wait").otherwise("fail")


#: Parts of messages that tell of memory running out.
MEMORY = ("memoryerror", "unable to allocate", "out of memory", "outofmemoryerror", "cannot allocate memory", "bad_alloc", "bad alloc", "cuda_error_out_of_memory", "cudaerrormemoryallocation", "cublas_status_alloc_failed")


def out_of_memory(message: Column | str) -> Column:
    text = F.lower(F.coalesce(_col(message), F.lit("")))
    found = F.lit(False)
    for part in MEMORY:
        found = found | text.contains(part)
    return found
