"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then a
joined filter. DataFrame functions only.

The sketch of a metric is a histogram over buckets of bounded relative width (32 for each power of two):
two sketches merge by adding counts, so partial sketches of tasks, sources and languages add up in any
order to the same result. A metric of a document is an integer, in parts of ten thousand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as C

SPACE = r"\x20\x09-\x0D"
#: metric -> the least spread its fence assumes.
METRICS = {"symbols": 150, "dup_lines": 400, "repeats": 400, "word_length": 3000}
#: A document fails a metric above q75 + FENCE * max(q75 - q25, least spread) of its group.
FENCE = 6
#: Groups of fewer documents take the sketch of their language, then of all documents.
LEAST_GROUP = 50
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ADDED = [*_BASE, "n_lines", "base_failed", "kept", "failed_rules"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that the text holds twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    zero, many = F.lit(0).cast("long"), 64

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2])))

    def twice(g: Column) -> Column:
        return _let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i + 1), F.lit(False)))))

    def places(g: Column, d: Column) -> Column:
        few = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
        by_value = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
        sorted_all = _let(by_value, lambda s: F.array_sort(F.transform(F.filter(s, lambda e, j: same(s, e, j - 1) | same(s, e, j + 1)), lambda e: e["i"])))
        return F.when(F.size(d) <= many, few).otherwise(sorted_all)

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), zero.alias("n"))
        return F.aggregate(p, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]

    return _let(hashes, lambda h: _let(windows(h), lambda g: _let(twice(g), lambda d: F.when(F.size(d) == 0, zero).otherwise(covered(places(g, d))))))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed.

    Words are runs without the six ASCII white-space characters; a null text has none. Columns of these
    names are replaced. Windows are compared by 64-bit hashes of words.
    """
    df = C.without(docs, _ADDED)
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_words": F.regexp_extract_all(t, F.lit(f"[^{SPACE}]+"), F.lit(0)), "_lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_words")),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_words", "_lines")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def _metric(name: str) -> Column:
    top, bottom = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}[name]
    return F.expr(f"({top} * 10000) div greatest({bottom}, 1)")


def _bucket(v: Column) -> Column:
    shift = (F.length(F.bin(v)) - 6).cast("int")
    wide = F.call_function("shiftright", v, F.greatest(shift, F.lit(0)))
    return F.when(v < 64, v).otherwise(shift * 32 + wide).cast("int")


def _value(b: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.when(b < 64, b.cast("long")).otherwise(F.call_function("shiftleft", F.pmod(b, F.lit(32)).cast("long") + 33, shift) - 1)


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language, source, metric and bucket with the number of documents that pass the base
    rules. Tasks pre-aggregate: a hot source sends some hundred rows per task, however many rows it has."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(_metric(m)).alias("bucket")) for m in METRICS])
    return measured.where(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(each)).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))


def _fences(cells: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of ``keys``: documents, and the fence of each metric."""
    cells = cells.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "metric")
    run = cells.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("bucket"))})
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    quartiles = run.groupBy(*keys, "metric").agg(F.first("total").alias("total"), _value(at(25)).alias("q25"), _value(at(75)).alias("q75"))
    least = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])[F.col("metric")]
    fence = F.col("q75") + F.lit(FENCE) * F.greatest(F.col("q75") - F.col("q25"), least)
    return quartiles.groupBy(*keys).agg(F.max("total").alias("n"), *[F.max(F.when(F.col("metric") == m, fence)).alias(m) for m in METRICS])


def thresholds(cells: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """Fences by language and source; small groups have those of the language, or else of all documents."""
    own, by_lang, overall = (_fences(cells, k) for k in (["lang", "source"], ["lang"], []))
    same = lambda a, b: a.eqNullSafe(b)
    up = own.alias("o").join(by_lang.alias("l"), same(F.col("o.lang"), F.col("l.lang")), "left").crossJoin(F.broadcast(overall).alias("a"))  # one row
    pick = lambda m: F.when(F.col("o.n") >= least_group, F.col(f"o.{m}")).when(F.col("l.n") >= least_group, F.col(f"l.{m}")).otherwise(F.col(f"a.{m}"))
    return up.select(F.col("o.lang").alias("_lang"), F.col("o.source").alias("_source"), *[pick(m).alias(f"_max_{m}") for m in METRICS])


def _verdict(measured: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    joined = measured.join(limits, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    failed = F.filter(F.array(*[F.when(_metric(m) > F.col(f"_max_{m}"), F.lit(m)) for m in METRICS]), lambda x: x.isNotNull())
    return joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_lang", "_source", *[f"_max_{m}" for m in METRICS])


def assess(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All columns but the text, the base metrics, ``failed_rules`` and ``kept``. The text is read once;
    only its metrics are stored, sketched and joined. Null languages and sources form groups of their own;
    an empty table gives none; repeated rows are judged each."""
    measured = C.materialize(with_base(docs, text).drop(text), "quality-metrics")
    return _verdict(measured, thresholds(sketch(measured, lang, source)), lang, source)


def filter_documents(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that ``assess`` keeps, with their own columns."""
    plain, restore = C.stow(docs, _ADDED)
    limits = C.materialize(thresholds(sketch(with_base(plain, text).drop(text), lang, source)), "quality-limits")
    return restore(_verdict(with_base(plain, text), limits, lang, source).where("kept"))


def report(docs: DataFrame) -> DataFrame:
    return assess(docs.select("doc_id", "text", "lang", "source")).select("doc_id", *_BASE, "base_failed", "kept")


def _report_sql() -> str:
    space = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bucket = lambda v: f"CASE WHEN {v} < 64 THEN {v} ELSE (length(bin({v})) - 6) * 32 + ({v} >> greatest(length(bin({v})) - 6, 0)) END"
    value = lambda b: f"CASE WHEN {b} < 64 THEN {b} ELSE (({b} % 32 + 33) << greatest({b} // 32 - 1, 0)) - 1 END"
    metrics = {"symbols": "n_symbols * 10000 // greatest(word_chars, 1)", "dup_lines": "n_dup_lines * 10000 // greatest(n_lines, 1)", "repeats": "n_repeat_words * 10000 // greatest(n_words, 1)", "word_length": "word_chars * 10000 // greatest(n_words, 1)"}
    cells = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {bucket(m)} AS bucket FROM v WHERE NOT base_failed" for m in METRICS)
    least = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in METRICS.items()) + " END"

    def fences(name: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        per = f"PARTITION BY {k}metric"
        out = ", ".join(f"max(CASE WHEN metric = '{m}' THEN fence END) AS {m}" for m in METRICS)
        return f"""{name}_q AS (SELECT {k}metric, max(total) AS total, min(CASE WHEN upto * 100 >= total * 25 THEN bucket END) AS b25, min(CASE WHEN upto * 100 >= total * 75 THEN bucket END) AS b75
          FROM (SELECT *, sum(n) OVER ({per}) AS total, sum(n) OVER ({per} ORDER BY bucket) AS upto FROM (SELECT {k}metric, bucket, count(*) AS n FROM cells GROUP BY {k}metric, bucket)) GROUP BY {k}metric),
        {name}_f AS (SELECT {k}max(total) AS n, {out} FROM (SELECT *, {value('b75')} + {FENCE} * greatest(({value('b75')}) - ({value('b25')}), {least}) AS fence FROM {name}_q) {'GROUP BY ' + keys if keys else ''})"""

    fails = " OR ".join(f"v.{m} > (CASE WHEN o.n >= {LEAST_GROUP} THEN o.{m} WHEN l.n >= {LEAST_GROUP} THEN l.{m} ELSE a.{m} END)" for m in METRICS)
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {space}, '')) > 0) AS lines FROM t),
    g AS (SELECT r, k, words[k : k + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS k FROM w WHERE len(words) > 2)),
    p AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(k, k + 3)) AS q FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
    b AS (SELECT w.r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(text, {space}, '')) AS BIGINT) AS word_chars,
            CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
          FROM w LEFT JOIN p ON p.r = w.r),
    v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{e} AS {m}" for m, e in metrics.items())} FROM b),
    cells AS ({cells}),
    {fences("o", "lang, source")}, {fences("l", "lang")}, {fences("a", "")}
    SELECT v.doc_id, {", ".join(f"v.{c}" for c in _BASE)}, v.base_failed, NOT v.base_failed AND NOT coalesce({fails}, false) AS kept
    FROM v LEFT JOIN o_f o ON o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source LEFT JOIN l_f l ON l.lang IS NOT DISTINCT FROM o.lang CROSS JOIN a_f a
    """


#: DuckDB SQL for ``report``.
REPORT_SQL = _report_sql()
