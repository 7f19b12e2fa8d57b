"""Nested settings as typed leaves: flatten, deep merge, coercion of edits, nesting. Built-in functions only.

Settings are JSON objects read into VARIANT; a leaf is a row (keys, steps, path, value): its keys from the root, the same
joined by dots, and its value as VARIANT, so that numbers, booleans, lists and nulls keep their kinds. Lists are leaves, and
so are empty objects. Objects may be nested to any depth: the depth of a table is one aggregate over its texts. Variants
can be neither compared nor grouped by, so operators join by steps and carry values along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP = "Top-level"
_STRING = r'"(?:[^"\\]++|\\.)*+"'


def nesting(text: str) -> Column:
    """The greatest number of objects that are open at once in a JSON text."""
    marks = F.regexp_replace(text, _STRING + r"|[^{}]", "")
    opened = F.transform(F.split(marks, ""), lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("top"))
    return F.aggregate(opened, start, lambda s, c: F.struct((s["d"] + c).alias("d"), F.greatest(s["top"], s["d"] + c).alias("top")), lambda s: s["top"])


def _inner(c: str) -> Column:
    return F.expr(f"try_variant_get({c}, '$', 'map<string,variant>')")


def _named(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return df.select(*keys, "steps", F.array_join("steps", ".").alias("path"), "value", *more)


def flatten(df: DataFrame, keys: list[str], settings: str, depth: int | None = None) -> DataFrame:
    """JSON objects (keys, settings) as leaves (keys, steps, path, value, group).

    A leaf's group is its outermost object, 'Top-level' for leaves of the root. NULL, text that is no JSON and text that is
    no object have no leaf, nor has an empty root. ``depth`` saves the look at the texts; deeper objects stay whole.
    """
    rows = df.select(*keys, F.col(settings).cast("string").alias("_t"))
    if depth is None:
        depth = rows.agg(F.max(nesting("_t"))).first()[0] or 0
    level = rows.select(*keys, F.expr("cast(array() as array<string>)").alias("steps"), F.try_parse_json("_t").alias("value")).where(_inner("value").isNotNull())
    for _ in range(depth):
        inner = _inner("value")
        below = F.transform(F.map_entries(inner), lambda e: F.struct(F.concat("steps", F.array(e["key"])).alias("steps"), e["value"].alias("value")))
        level = level.select(*keys, F.explode(F.when(F.size(inner) > 0, below).otherwise(F.array(F.struct("steps", "value")))).alias("_e")).select(*keys, "_e.*")
    return _named(level.where(F.size("steps") > 0), keys).withColumn("group", F.when(F.size("steps") > 1, F.col("steps")[0]).otherwise(TOP))


def as_text(leaves: DataFrame) -> DataFrame:
    """Leaves with their values as text: strings bare, all else as JSON."""
    string = F.schema_of_variant("value") == "STRING"
    return leaves.withColumn("value", F.when(string, F.expr("try_variant_get(value, '$', 'string')")).otherwise(F.to_json("value")))


def merge(base: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """Deep merge of leaves: objects merge, anything else of the overlay replaces what the base has in its place.

    So base leaves at or below an overlay leaf go, and a base leaf goes where the overlay has an object. An empty object
    of the overlay adds nothing to an object of the base. Sorted by steps, what lies below a leaf follows it directly, so
    that a leaf's nearest neighbours of the other side tell: one shuffle by keys, whose sorts spill, and no join. No leaf of
    the overlay stands above another of its key, as in one object or copies of it.
    """
    empty = F.coalesce(F.size(_inner("value")) == 0, F.lit(False))
    both = [x.select(*keys, "steps", "value", F.lit(new).alias("_new"), (empty if new else F.lit(False)).alias("_empty")) for x, new in ((base, False), (overlay, True))]
    up = Window.partitionBy(*keys).orderBy("steps", "_new").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("steps"), F.desc("_new")).rowsBetween(Window.unboundedPreceding, 0)
    starts = lambda long, short: F.coalesce(F.slice(long, F.lit(1), F.size(short)) == F.col(short), F.lit(False))
    rows = both[0].unionByName(both[1])
    rows = rows.withColumn("_below", F.last(F.when(~F.col("_new"), F.col("steps")), ignorenulls=True).over(down))
    rows = rows.withColumn("_set", F.when(F.col("_new") & ~(F.col("_empty") & starts("_below", "steps")), F.col("steps")))
    rows = rows.withColumn("_after", F.last("_set", ignorenulls=True).over(down))
    rows = rows.withColumn("_before", F.last("_set", ignorenulls=True).over(up))
    gone = starts("_after", "steps") | starts("steps", "_before")
    return _named(rows.where(F.when(F.col("_new"), F.col("_set").isNotNull()).otherwise(~gone)), keys)


def _literal(raw: Column) -> Column:
    """A list, number, word or text as typed by hand, in JSON or with single quotes, round brackets, True, False, None."""
    words = raw
    for pattern, to in ((r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null"), ("'", '"'), (r"\(", "["), (r",?\s*\)", "]"), (r",\s*\]", "]")):
        words = F.regexp_replace(words, pattern, to)
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(words))


def changed(edited: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Edited leaves coerced to the kind of the base's value, only where they differ from it: (keys, steps, path, value).

    By the base's kind: booleans take 'true', 'false', or whether the edit is something (not 0, not empty); whole numbers are
    cut towards zero, up to 38 digits; fractions take any number, NaN too; lists, objects and nulls take lists and nulls, or
    text that reads as a literal, blank or 'none' being null; texts take what comes. What can't be coerced is the base's
    value and so no change. A path that the base lacks counts as null there.
    """
    j = edited.select(*keys, "steps", F.col("value").alias("raw"), F.schema_of_variant("value").alias("_rk"))
    j = j.join(base.select(*keys, "steps", F.col("value").alias("base"), F.schema_of_variant("value").alias("_k")), [*keys, "steps"], "left")
    text = F.trim(F.coalesce(F.expr("try_variant_get(raw, '$', 'string')"), F.to_json("raw")))
    j = j.withColumns({"_k": F.coalesce("_k", F.lit("VOID")), "_text": text})
    number = F.expr("coalesce(try_variant_get(raw, '$', 'double'), try_cast(_text as double))")
    as_variant = lambda c: c.cast("variant")
    cut = F.expr("try_cast(coalesce(try_variant_get(raw, '$', 'double'), try_cast(_text as double)) as decimal(38,0))")
    cut = F.when(F.abs(number) < 1e15, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("decimal(38,0)")).otherwise(cut)
    small = F.expr("try_cast(_cut as bigint)")
    none = (F.col("_text") == "") | (F.lower("_text") == "none")
    j = j.withColumns({"_n": number, "_cut": F.when(F.isnan(number), F.lit(None)).otherwise(cut)})
    truth = F.when(F.lower("_text").isin("true", "false"), F.lower("_text") == "true").when(F.col("_n").isNotNull() & ~F.isnan("_n") & (F.col("_rk") != "STRING"), F.col("_n") != 0)
    truth = F.coalesce(truth, (F.col("_rk") != "VOID") & ~F.col("_text").isin("", "[]", "{}"))
    typed = (
        F.when(F.col("_k") == "BOOLEAN", as_variant(truth))
        .when(F.col("_k") == "BIGINT", F.coalesce(as_variant(small), as_variant(F.col("_cut")), F.col("base")))
        .when(F.col("_k").rlike("^(DOUBLE|FLOAT|DECIMAL)"), F.coalesce(as_variant(F.col("_n")), F.col("base")))
        .when(F.col("_k") == "STRING", F.col("raw"))
        .when(F.col("_rk") != "STRING", F.col("raw"))
        .when(none, F.parse_json(F.lit("null")))
        .otherwise(F.coalesce(_literal(F.col("_text")), F.col("base")))
    )
    out = j.withColumn("value", typed)
    numbers = F.expr("try_variant_get(value, '$', 'double') = try_variant_get(base, '$', 'double')")
    both = F.schema_of_variant("value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & F.col("_k").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    same = F.coalesce(both & numbers, F.lit(False)) | (F.to_json("value") == F.coalesce(F.to_json("base"), F.lit("null")))
    return _named(out.where(~same), keys)


def nest(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves of any depth as JSON objects (keys, settings); flatten, then nest gives the objects again.

    Leaves sorted by their steps are written one after the other: each closes and opens the objects between its place and
    its predecessor's. Steps are unique in a group, and no leaf stands above another. Groups without leaves have no row.
    """
    names = F.transform("steps", lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", ""))
    entry = F.struct("steps", names.alias("names"), F.coalesce(F.to_json("value"), F.lit("null")).alias("text"))
    rows = leaves.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    # Number of leading steps that a leaf shares with its predecessor.
    shared = "size(filter(sequence(1, least(size(x.steps), size(_e[i - 1].steps))), n -> slice(x.steps, 1, n) = slice(_e[i - 1].steps, 1, n)))"
    piece = f"""transform(_e, (x, i) -> named_struct('s', if(i = 0, 0, {shared}), 'x', x, 'before', if(i = 0, 1, size(_e[i - 1].steps))))"""
    text = """array_join(transform(_p, (p, i) -> concat(
        repeat('}', greatest(p.before - 1 - p.s, 0)), if(i = 0, '', ','),
        array_join(transform(slice(p.x.names, p.s + 1, size(p.x.names) - 1 - p.s), n -> concat(n, ':{')), ''),
        element_at(p.x.names, -1), ':', p.x.text)), '')"""
    return rows.withColumn("_p", F.expr(piece)).select(*keys, F.concat(F.lit("{"), F.expr(text), F.expr("repeat('}', size(element_at(_e, -1).steps))")).alias("settings"))
