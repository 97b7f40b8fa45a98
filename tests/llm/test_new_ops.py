"""Operators 11 to 13 against brute force: nulls, empties, ties, repeats, very long texts, empty tables, clashing names."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seedquorum.llm import divergence, exact, periodic

SPACE = re.compile(r"[\x20\x09-\x0D]")
ODD = [None, "", "  \n", "one", "ÉÀ ñ\n\tç", "a b c", "ab c", "abc", "x " * 3000, "日本語 ▁ 😀 日本語", "no break no break", "A a B b " * 9]


def runs_by_hand(words):
    """Maximal runs by trying each start, end and smallest period."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                s = words[i : j + q]
                least = next(p for p in range(1, len(s) + 1) if all(s[k] == s[k + p] for k in range(len(s) - p)))
                if least == q and len(s) >= max(12, 2 * q):
                    out.append((i, len(s), q))
            i = max(i + 1, j)
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 7)), max_size=8))
def test_runs_equal_brute_force(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert periodic.find_runs(words) == runs_by_hand(words)


def test_runs_of_many_words_and_planes():
    r = random.Random(3)
    loop = [f"w{r.randrange(5000)}" for _ in range(700)]
    words = [f"w{r.randrange(5000)}" for _ in range(900)] + loop * 3 + loop[:5] + ["end"]
    assert (900, 2105, 700) in periodic.find_runs(words) and periodic.find_runs(words) == runs_by_hand(words)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    texts = list(ODD)
    for _ in range(150):
        loop = " ".join(r.choice(["tic", "tac", "toe", "Éa"]) for _ in range(r.randint(1, 8)))
        texts.append(" ".join(r.choice(["red", "Blue", "green", "x1y"]) for _ in range(r.randint(0, 40))) + "\n" + " ".join([loop] * r.randint(1, 9)))
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "", None]), 7, True) for i, t in enumerate(texts)]
    rows += [rows[15], (None, texts[20], "en", "s1", 7, True), (4000, "x  " * 3000, "fr", "s9", 7, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, runs int, `kept` boolean").repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def test_periodic_runs(docs, rows):
    got = periodic.periodic_runs(docs).collect()
    assert got[0].__fields__ == ["doc_id", "lang", "source", "runs", "kept", "runs_", "collapsed"] and len(got) == len(rows)
    want = collections.Counter()
    for x in rows:
        words = (x["text"] or "").encode().split()
        found = runs_by_hand(words) if len(words) < 1000 else [(0, 3000, 1)]
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        want[x["doc_id"], tuple(found), b" ".join(w for i, w in enumerate(words) if i not in drop).decode()] += 1
    assert collections.Counter((x["doc_id"], tuple((a["start"], a["length"], a["period"]) for a in x["runs_"]), x["collapsed"]) for x in got) == want
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_op12_query(spark, docs, tmp_path):
    docs.drop("runs", "kept").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x["doc_id"], x["n_runs"], x["start"], x["length"], x["period"], x["exponent_milli"], x["runs_sha256"], x["collapsed_sha256"]) for x in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()}
    want, looped = set(), 0
    for x in docs.collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (x["text"] or "").encode())
        n, h = len(words), zlib.crc32(str(x["doc_id"]).encode()) if x["doc_id"] is not None else 1
        if h % 10 == 0 and n:
            g, looped = h // 10, looped + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = runs_by_hand(words) if n < 1000 else [(0, 3000, 1)]
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda f: (-f[1], f[0], f[2])) if found else None
        digest = lambda b: hashlib.sha256(b).hexdigest()
        cells = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.add((x["doc_id"], len(found), *cells, digest("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in drop))))
    assert got == want and looped > 5


def kept_by_hand(rows):
    groups = collections.defaultdict(list)
    for x in rows:
        groups[SPACE.sub("", x["text"] or "")].append((-len(x["text"] or ""), x["doc_id"] is None, x["doc_id"]))
    return {t: (min(g, key=lambda y: (y[0], y[1], y[2] or 0))[2], len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("partitions", [1, 40])
def test_exact_groups(spark, docs, rows, partitions):
    """With 40 partitions the groups of copies are dealt to several parts and meet again."""
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        many = docs.unionByName(spark.range(5000, 5300).selectExpr("id AS doc_id", "concat(repeat(' ', cast((id + 1) % 3 AS int)), 'a hot', char(10), 'text') AS text", "'en' AS lang", "'s' AS source", "1 AS runs", "true AS kept"))
        rows = many.collect()
        want = kept_by_hand(rows)
        got = exact.exact_groups(many).collect()
        for_text = {hashlib.sha256(t.encode()).hexdigest(): (*v, t) for t, v in want.items()}
        assert sorted((x["id"] is None, x["id"] or 0) for x in got) == sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in rows)
        assert all((x["keep_id"], x["group_size"]) == for_text[x["text_sha256"]][:2] for x in got)
        stay = [x for x in got if x["kept"]]
        assert len(stay) == len(want) and all(x["id"] == x["keep_id"] for x in stay)
        assert for_text[hashlib.sha256(b"ahottext").hexdigest()][:2] == (5002, 300)
        assert sorted(SPACE.sub("", x["text"] or "") for x in exact.one_of_each_text(many).collect()) == sorted(want)
        assert exact.one_of_each_text(many).columns == many.columns and exact.exact_groups(docs.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def divergence_by_hand(rows, least, top):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    counts, df, sources = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for x in rows:
        lang, source = x["lang"] or "", x["source"] or ""
        words = [lower(w) for w in word.findall(x["text"] or "")]
        sources[lang].add(source)
        counts.update((lang, source, w) for w in words)
        df.update((lang, w) for w in set(words))
    out = set()
    for lang, every in sources.items():
        kept = [w for (at, w), n in df.items() if at == lang and n >= least]
        total = {s: sum(counts[lang, s, w] for w in kept) for s in every}
        p = {(s, w): 1 + 10**9 * (counts[lang, s, w] + 2) // (total[s] + 2 * len(kept)) for s in every for w in kept}
        q = {w: 1 + 10**9 * (sum(counts[lang, s, w] for s in every) + 2) // (sum(total.values()) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in every:
            pairs = sorted(((-sum(f(p[s, w], p[o, w]) for w in kept), o.encode()) for o in every - {s}))
            terms = sorted((-f(p[s, w], q[w]), w.encode()) for w in kept if counts[lang, s, w] and p[s, w] > q[w])[:top]
            out |= {(lang, s, part, o.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, o) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("least", [1, 10, 10**6])
def test_source_divergence(docs, rows, least, monkeypatch):
    if least == 1:
        monkeypatch.setattr(divergence, "BROADCAST_SOURCES", 0)
    got = [tuple(x) for x in divergence.source_divergence(docs, least).collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_by_hand(rows, least, 10) and got
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_shares_beyond_a_long(spark):
    """1e9 times a count of 9.3e9 does not fit a long."""
    got = spark.range(1).selectExpr("9300000000 AS c", "9300000001 AS t", "1 AS n_terms").selectExpr(f"{divergence._share('c', 't')} AS p").first()["p"]
    assert got == 1 + 10**9 * 9300000002 // 9300000003
