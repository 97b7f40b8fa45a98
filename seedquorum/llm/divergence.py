"""Source divergence audit: how far the wording of each source stands from the others of its language.

Terms are counted once, in tasks, by NumPy over the texts' bytes. Each kept term is then one wide row: its counts pivoted into an
array indexed by the language's sources. JVM higher-order functions turn it into smoothed shares and emit one contribution for
each pair of sources; partial aggregation adds these up in the tasks that made them, so a shuffle carries pairs, not terms.

Shares are fixed-point integers and sums are exact: counts go through decimal(38,0), contributions fit a long.

Defined cases: null text, language and source count as ''; a language without kept terms has pairs of value 0 and no term rows;
a source without terms has the smoothed share of zero counts; repeated rows are documents each; an empty table gives no rows; texts
are read whole, at any length (a text is never cut, so a task holds the longest one); ties go by the UTF-8 bytes of the item; columns besides
the three aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.plans.workspace import Workspace

#: Bytes of a term: ASCII letters and all of non-ASCII characters.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SCALE = 1_000_000_000
#: Sources of all languages together that are still broadcast (some 50 bytes each); beyond, the terms meet them in a join that Spark may split.
BROADCAST_SOURCES = 200_000
_COUNTS = "lang string, source string, term string, n long, docs long"


@T.released
def count_terms(batches):
    """(lang, source, text) to the occurrences and documents of each (lang, source, term) of some megabytes of text."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(c).cast(pa.string()), "").dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(zero_copy_only=False)
        data, offs = T.flat(batch.column("text"))
        for i, j in T.blocks(offs, 4 << 20):
            d, bounds = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            inside = IS_TERM[d]
            start, end = T.runs(inside, bounds)
            if not len(start):
                continue
            ends = np.concatenate([[0], np.cumsum(end - start)])
            terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(T.LOWER[d[inside]])]).dictionary_encode()
            k = len(terms.dictionary)
            in_row = np.searchsorted(bounds, start, "right") - 1
            pair, n = np.unique(in_row * k + terms.indices.to_numpy(), return_counts=True)  # a document's term
            key = group[i + pair // k] * k + pair % k
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            g, t = key[first] // k, key[first] % k
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(g // max(1, len(source.dictionary)))),
                    source.dictionary.take(pa.array(g % max(1, len(source.dictionary)))),
                    terms.dictionary.take(pa.array(t)).cast(pa.string()),
                    pa.array(np.add.reduceat(n, first).astype(np.int64)),
                    pa.array(np.diff(np.concatenate([first, [len(key)]])).astype(np.int64)),
                ],
                schema=schema,
            )


def _share(count: str, total: str) -> str:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact."""
    return f"1 + ((cast({count} + 2 AS decimal(20, 0)) * {SCALE}) div ({total} + 2 * n_terms))"


def term_vectors(docs: DataFrame, min_docs: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(lang, sources, totals, n_terms): a row per language, its sources in order with the occurrences of kept terms;
    (lang, term, counts): a row per kept term, its occurrences by place in ``sources``."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = docs.mapInArrow(count_terms, _COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source")).where(F.col("docs") >= min_docs)
    kept = work.write(kept, "kept")
    totals = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    every = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    langs = every.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    langs = work.write(langs.select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("totals"), F.coalesce("v", F.lit(0)).alias("n_terms")), "langs")
    small = (langs.agg(F.sum(F.size("sources"))).first()[0] or 0) <= BROADCAST_SOURCES
    wide = kept.join(F.broadcast(langs) if small else langs, "lang")
    return langs, wide.withColumn("counts", F.expr("transform(sources, s -> coalesce(try_element_at(by_source, s), 0L))")).drop("by_source", "docs")


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """``docs`` (lang, source, text) to (lang, source, part, item, value, rank): ``pair`` rows hold the divergence from each
    other source of the language, ``term`` rows the ``top`` terms that a source has more often than its language."""
    work = Workspace(docs.sparkSession, "divergence")
    langs, wide = term_vectors(docs, min_docs, work)
    shared = wide.withColumn("p", F.expr(f"transform(counts, (c, i) -> {_share('c', 'totals[i]')})"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    after = "slice({x}, i + 2, greatest(size({x}) - i - 1, 0))"
    parts = f"flatten(transform(p, (a, i) -> transform({after.format(x='p')}, b -> ((a - b) * (a - b)) div (a + b))))"
    sums = shared.select("lang", F.posexplode(F.expr(parts)).alias("at", "f")).groupBy("lang", "at").agg(F.sum("f").alias("value"))
    names = langs.select("lang", F.posexplode(F.expr(f"flatten(transform(sources, (a, i) -> transform({after.format(x='sources')}, b -> struct(a, b))))")).alias("at", "x"))
    both = names.join(sums, ["lang", "at"], "left").select("lang", F.expr("inline(array(struct(x.a AS source, x.b AS item), struct(x.b AS source, x.a AS item)))"), F.coalesce("value", F.lit(0)).alias("value"))
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    whole = "aggregate({x}, 0L, (a, x) -> a + x)"
    shared = shared.withColumn("q", F.expr(_share(whole.format(x="counts"), whole.format(x="totals"))))
    more = "filter(transform(p, (x, i) -> struct(sources[i] AS source, counts[i] AS n, x AS p, ((x - q) * (x - q)) div (x + q) AS value)), x -> x.n > 0 AND x.p > q)"
    terms = shared.select("lang", F.col("term").alias("item"), F.expr(f"inline({more})")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pair.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM d),
c AS (SELECT lang, source, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
kc AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS n FROM kc GROUP BY ALL),
p AS (SELECT kc.lang, kc.source, kc.term, kc.n, 1 + (1000000000::HUGEINT * (kc.n + 2)) // (t.n + 2 * v.v) AS p FROM kc JOIN t USING (lang, source) JOIN v ON v.lang = kc.lang),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q FROM k JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
