"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule. Policies are
versioned masks over those bits, so a new policy or an ablation never reads a text again.

Defined cases: null and empty texts measure zero and fail ``few_words``; repeated rows each give their own ledger row;
an empty table gives an empty ledger; columns besides the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedquorum.llm import text as T

SPACE_CLASS = r"[ \x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"

#: name -> SQL predicate over the measurements; the position is the bit. Integer arithmetic, so every engine agrees.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "upper_case": "2 * n_upper > word_chars",
    "exclamations": "2 * n_exclaim > n_words",
}
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "symbols", "repeated_lines"), "v2": tuple(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim")


def mask_of(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more, from the windows' hashes in text order.

    Sorts (hash, position) once and looks at neighbours: O(n log n) for texts of any length.
    """

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = lambda x, i, d: (i + d >= 0) & (i + d < n) & (F.get(s, i + d)["h"] == x["h"])
        hits = F.filter(s, lambda x, i: F.coalesce(same(x, i, -1) | same(x, i, 1), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.transform(F.array(F.sort_array(pairs)), covered)[0]


def measure(docs: DataFrame, key: str | None = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key and ``MEASURES``, all long. Without a key, the whole row as the struct ``row``."""
    t = F.col("_t")
    d = docs.select((F.col(key) if key else F.struct(*docs.columns)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select("_key", "_t", F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != "").alias("_w"))
    w = F.col("_w")
    windows = F.transform(F.array(w), lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2))))[0]
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.select(
        "_key",
        F.size(w).alias("n_words"),
        F.length(F.translate(t, SPACES, "")).alias("word_chars"),
        _without(t, SYMBOLS).alias("n_symbols"),
        _without(t, UPPER).alias("n_upper"),
        _without(t, "!").alias("n_exclaim"),
        lines.alias("_lines"),
        windows.alias("_h"),
    )
    h, lines = F.col("_h"), F.col("_lines")
    d = d.select(
        "*",
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), _repeat_words(h)).otherwise(F.lit(0)).alias("n_repeat_words"),
    )
    return d.select(F.col("_key").alias(key or "row"), *(F.col(m).cast("long").alias(m) for m in MEASURES))


def ledger(docs: DataFrame, key: str | None = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and ``failed``: bit i is set where rule i of ``RULES`` fails."""
    bits = " + ".join(f"CASE WHEN {sql} THEN {1 << i}L ELSE 0L END" for i, sql in enumerate(RULES.values()))
    return measure(docs, key, text).withColumn("failed", F.expr(bits))


def verdict(policy: str) -> Column:
    """True where no rule of the policy failed; over a ledger."""
    return F.expr(f"(failed & {mask_of(POLICIES[policy])}L) = 0")


def passing(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns, of any names."""
    names = T.numbered(docs.columns)
    rows = ledger(docs.toDF(*names), None, names[docs.columns.index(text)])
    return rows.where(verdict(policy)).select("row.*").toDF(*docs.columns)


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects (kept if it were dropped).

    One pass over the stored masks, one row per rule; partial aggregation leaves a row per task to shuffle.
    """
    mask, names = mask_of(POLICIES[policy]), list(RULES)
    aggs = []
    for r in POLICIES[policy]:
        bit = 1 << names.index(r)
        aggs += [F.count_if(F.expr(f"(failed & {bit}L) <> 0")).alias(f"{r}__fails"), F.count_if(F.expr(f"(failed & {mask}L) = {bit}L")).alias(f"{r}__alone")]
    one = book.agg(F.count("*").alias("n"), *aggs)
    rows = [F.struct(F.lit(r).alias("rule"), F.col("n").alias("n_documents"), F.col(f"{r}__fails").alias("n_failed"), F.col(f"{r}__alone").alias("n_failed_alone")) for r in POLICIES[policy]]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.expr(f"(failed & {mask_of(BASE)}L) <> 0")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict("v2")).alias("kept"), "failed")


_CASES = " + ".join(f"CASE WHEN {sql} THEN {1 << i} ELSE 0 END" for i, sql in enumerate(RULES.values()))
OP9_SQL = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, rid, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (
        SELECT rid, unnest(range(len(w) - 2)) AS i, unnest([struct_pack(a := w[k + 1], b := w[k + 2], c := w[k + 3]) for k in range(len(w) - 2)]) AS g FROM w WHERE len(w) >= 3)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^{UPPER}]', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaim,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, ({_CASES})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask_of(BASE)}) <> 0 AS base_failed,
       (failed & {mask_of(POLICIES["v2"])}) = 0 AS kept, failed FROM f
"""
