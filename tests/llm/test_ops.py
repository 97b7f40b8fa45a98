"""Operators against brute force on small tables with nulls, empties, ties, repeats, long texts, extra columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seedquorum.llm import chat, licenses, neardup, packing, passages, pieces, quality, tokenfile, tokens, toxicity, vectors

WORDS = [f"w{i}" for i in range(400)]
ODD = [None, "", "   ", "one", "ÉÀ ñ\n\tç", "a b c", "x " * 3000, "same text here for all of us to read " * 20, "same text here for all of us to read " * 20, "<|endoftext|> a  b ", "日本語 ▁ 😀"]


def texts(n=40, seed=0):
    r = random.Random(seed)
    out = list(ODD)
    base = [r.choice(WORDS) for _ in range(200)]
    for _ in range(n):
        t = list(base) if r.random() < 0.5 else [r.choice(WORDS) for _ in range(r.randint(1, 300))]
        for _ in range(r.randint(0, 12)):
            t[r.randrange(len(t))] = r.choice(WORDS)
        out.append(" ".join(t) + r.choice(["", ".\n" + " ".join(base[:90])]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", "rep", 7) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[20]], "doc_id long, text string, n string, rep string, component_id int")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, rows, none):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = neardup.near_duplicates(docs, k=4).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), want[i]) for i in sets}
    assert len(links) > 5 and neardup.near_duplicates(none, k=4).count() == 0
    kept = neardup.one_of_each(docs, 4)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i] == i)


@pytest.mark.parametrize("block", [1024, 4, 1])
def test_near_duplicates_in_a_crowd(spark, block, monkeypatch):
    """A crowd of near copies below and above the threshold, in leaves small and large: the rest step finds all."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(5)
    base = [r.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(r.randint(2, 7)):
            t[r.randrange(120)] = f"q{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == want and len(set(want.values())) > 1


def test_neighbours_share_prefixes():
    """The common prefix of sorted neighbours is counted in minima from the region's four on."""
    tails = np.array([[1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 9, 5, 6, 7, 8], [1, 2, 3, 9, 5, 6, 7, 8]], ">u4")
    batch = pa.record_batch({"region": [5, 5, 5], "tail": [x.tobytes() for x in tails], "point": [1, 2, 3], "n": [10, 10, 10], "small": [bytes(128)] * 3})
    got = {(r["a"], r["b"]): r["shared"] for out in neardup._neighbours(80)([batch]) for r in out.to_pylist()}
    assert got == {(1, 2): 7, (2, 3): 12, (1, 3): 7}


def test_one_id_with_two_texts_and_null_ids(spark):
    long = [f"u{i}" for i in range(200)]
    a, b, c = " ".join(long), " ".join([*long[:199], "z"]), " ".join(f"v{i}" for i in range(100))
    rows = [(1, a), (7, c), (7, b), (None, c), (None, "own words of nobody else at all here"), (None, ""), (9, ""), (9, "")]
    docs = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, `own_doc` int")
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in neardup.near_duplicates(docs).collect())
    assert got == sorted([("1", 196, "1"), ("7", 96, "7"), ("7", 196, "1"), ("None", 96, "7"), ("None", 4, "None"), ("None", 0, "None"), ("9", 0, "9"), ("9", 0, "9")])
    kept = neardup.one_of_each(docs.withColumnRenamed("own_doc", "a.b"))
    assert kept.columns == ["doc_id", "text", "a.b"] and sorted((str(x[0]), x[1][:5]) for x in kept.collect()) == sorted([("1", a[:5]), ("7", c[:5]), ("None", "own w"), ("None", ""), ("9", "")])


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_passages(docs, rows, none, hot):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = collections.Counter()
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    old, passages.HOT = passages.HOT, hot
    try:
        got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in passages.remove_repeated(docs).collect())
    finally:
        passages.HOT = old
    assert got == want and any(k[2] for k in want)
    assert passages.remove_repeated(none).count() == 0
    assert passages.without_repeats(docs).schema == docs.schema


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_words(spark, hot, monkeypatch):
    """Windows of words that another document has, whatever white space is between; rows of one id, null too, are one document."""
    monkeypatch.setattr(passages, "HOT", hot)
    r = random.Random(4)
    shared = [[r.choice(WORDS) for _ in range(n)] for n in (51, 50, 60, 51)]
    rows = []
    for i in range(60):
        own = [r.choice(WORDS) for _ in range(r.randint(20, 80))]
        for s in r.sample(shared, r.randint(0, 2)):
            k = r.randrange(len(own))
            own[k:k] = s
        rows.append((i // 2 if i > 50 else i, "".join(w + r.choice([" ", "\n", "\t "]) for w in own)))
    own = [r.choice(WORDS) for _ in range(70)]
    rows += [(100, " ".join(own + ["x"] + own)), (None, " ".join(shared[0])), (None, " ".join(own[:5] + shared[0])), (101, None), (102, ""), (103, " ".join(shared[1]))]
    holders = collections.defaultdict(set)
    split = [(i, list(re.finditer(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 50):
            holders[tuple(m.group() for m in w[k : k + 51])].add(i)
    want = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 50):
            if len(holders[tuple(m.group() for m in w[k : k + 51])]) > 1:
                gone |= set(range(w[k].start(), w[k + 50].end()))
        want.append((str(i), sum(p - 1 not in gone for p in gone), len(gone)))
    docs = spark.createDataFrame([(*x, "d", "r", 3) for x in rows], "doc_id long, text string, own_doc string, `own.ranges` string, n_chars int")
    got = sorted((str(x["doc_id"]), len(x["spans"]), x["n_removed"]) for x in passages.remove_repeated(docs, kind=passages.WORDS).collect())
    assert got == sorted(want) and sum(x[2] > 0 for x in want) > 20 and ("100", 0, 0) in want
    out = passages.without_repeats(docs, kind=passages.WORDS)
    assert out.columns == docs.columns and sorted((str(x["doc_id"]), len(x["text"] or "") + 0) for x in out.collect()) == sorted((str(i), len(t or "") - n) for (i, t), (_, _, n) in zip(rows, want, strict=True))


def test_suffix_sorter_verifies_bytes(monkeypatch):
    """With a hash that calls everything equal, the order still comes from the bytes."""
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab") for _ in range(30)) for _ in range(50)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    at, size, group = np.arange(50) * 30, np.full(50, 30), np.zeros(50, int)
    for broken in (False, True):
        s = passages.SuffixSorter(data, passages.T.prefix_sums(data), at, size, group, True)
        if broken:
            monkeypatch.setattr(s, "_same", lambda i, j, t: np.ones(len(i), bool))
        order, ext = s.sorted_extensions()
        assert [strings[i] for i in order] == sorted(strings)
        assert all(strings[order[k]][: ext[k]] == strings[order[k - 1]][: ext[k]] for k in range(1, 50))


def test_encoder_is_the_library(monkeypatch):
    enc = tokens.Encoder(tokens.default_path(), 2)
    all_ = [*texts(20), "a  b", " a", "a ", "x \n y", "it's 12'll", "a\x1c b", "\x00ab c", "tab\tx y", "½ ² a_b", "a,b c, d. e.", "a\nB c.\nDe\n\nf"]
    r = random.Random(9)
    parts = [" ", " ", "\n", "a", "Zb", "é", "'s", "'", "!", ".", "\u00a0", "\t", "\u2009", "1", "²", "e\u0301", "日", "<|endoftext|>", "\n\n", "_", "×", "\r\n", "\x00", "\u3000", "😀", "\u0085"]
    all_ += ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(5000)]
    for size in (tokens.SLICE, 300):
        got = [(ids, n) for _, _, ids, n in enc.slices(pa.array(all_), size)]
        ids, cut = np.concatenate([x for x, _ in got]), np.append(0, np.cumsum(np.concatenate([n for _, n in got])))
        assert all(ids[cut[i] : cut[i + 1]].tolist() == [*(enc.whole(t) if t else ()), 2] for i, t in enumerate(all_))


def test_rank_coding_round_trip():
    for x in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(np.random.default_rng(0).integers(0, 70000, 1001))):
        x = np.array(x, np.uint32)
        c, d = tokenfile.encode_ranks(x)
        assert (tokenfile.decode_ranks(np.frombuffer(c, np.uint8), np.frombuffer(d, np.uint8), len(x)) == x).all()


def test_token_files(docs, rows, none, tmp_path, spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    docs = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [*rows, (None, dict(rows)[3])]
    tokenfile.write_token_files(docs, str(tmp_path / "a"), tokens.default_path(), 2, shards=3)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.read_token_files(spark, str(tmp_path / "a")).collect()), key=key)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    tokenfile.write_token_files(none, str(tmp_path / "b"), tokens.default_path(), 2)
    assert tokenfile.read_token_files(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("capacity", [64, packing.CAPACITY])
def test_packing(docs, rows, none, capacity):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    docs, rows = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))), [*rows, (None, dict(rows)[3])]
    want, total = collections.Counter(), 0
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        want.update((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(itertools.pairwise(cuts)))
        total += len(ids)
    got = packing.pack_documents(docs, capacity=capacity).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    assert len(by) <= 1 + 1.1 * total / capacity and packing.pack_documents(none).count() == 0


def test_solver_is_near_optimal():
    r, worse = random.Random(3), 0
    for _ in range(150):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 10))), reverse=True)
        bins, _ = packing.solve(dict(collections.Counter(items)), 20)
        assert collections.Counter(s for n, ls in bins for s in ls for _ in range(n)) == collections.Counter(items) and all(sum(ls) <= 20 for _, ls in bins)
        best = [len(items)]

        def go(i, b, items=items, best=best):
            if len(b) >= best[0]:
                return
            if i == len(items):
                best[0] = len(b)
                return
            for k in {x: k for k, x in enumerate(b)}.values():
                if b[k] + items[i] <= 20:
                    go(i + 1, [*b[:k], b[k] + items[i], *b[k + 1 :]])
            go(i + 1, [*b, items[i]])

        go(0, [])
        worse += sum(n for n, _ in bins) > best[0]
    assert worse <= 3


def test_sentencepiece_is_the_unigram_library(tmp_path):
    import sentencepiece

    path = tokens.default_path("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    # the library runs the same Viterbi when the file says unigram: trainer_spec (field 2), model_type (field 3) = 1
    for p in [m.start() for m in re.finditer(b"\x18\x02", raw)][::-1]:
        trial = raw[:p] + b"\x18\x01" + raw[p + 2 :]
        try:
            lib = sentencepiece.SentencePieceProcessor(model_proto=trial)
        except RuntimeError:
            continue
        if lib.encode(" the") != sentencepiece.SentencePieceProcessor(model_file=path).encode(" the"):
            break
    (tmp_path / "unigram.model").write_bytes(trial)
    codec = pieces.Codec(str(tmp_path / "unigram.model"))
    assert isinstance(codec.viterbi, pieces.Viterbi)
    for t in ["this is a simple test of words", "  double  spaces ", "thonoued hetian, with that.", "a" * 40, ""]:
        ids, _ = codec.encode([t])
        scores = [codec.model.pieces[i][1] for i in ids]
        theirs = [codec.model.pieces[i][1] for i in lib.encode(t)]
        assert sum(scores) >= sum(theirs)


def test_sentencepiece_ids_are_the_bpe_library(tmp_path):
    import random

    import sentencepiece

    path = tokens.default_path("piece_bpe_32k.model")
    lib, codec, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(path), random.Random(5)
    assert isinstance(codec.viterbi, pieces.Merging)
    letters = ["  ab", " \n\tab", "abcdeht rsn ", "aab ", "▁ a", "中é a💥th", " the in er on"]
    mixed = ["".join(rng.choice(a) for _ in range(rng.randrange(60))) for a in letters * 200]
    whole = texts(30) + mixed + ["", None, "a" * 5000, " " * 300, "ab" * 3000 + "💥" * 50]
    ids, n = codec.encode(whole)
    assert ids.tolist() == [i for t in whole for i in lib.encode(t or "")] and n.tolist() == [len(lib.encode(t or "")) for t in whole]


def test_neighbours_stay_as_merging_says():
    import random

    codec, rng = pieces.Codec(tokens.default_path("piece_bpe_32k.model")), random.Random(7)
    v, normal = codec.viterbi, [i for i, p in enumerate(codec.model.pieces) if p[2] == pieces.NORMAL]
    for _ in range(5000):
        a, b = rng.choice(normal), rng.choice(normal)
        names = [v._name(a), v._name(b)]
        if v.merge(names[0]) == names[:1] and v.merge(names[1]) == names[1:]:
            assert v._stay(a, b, 0) == (v.merge("".join(names)) == names)


def test_viterbi_is_best_and_decodes(tmp_path):
    path = tokens.default_path("piece_bpe_32k.model")
    codec = pieces.Codec(path)
    viterbi = pieces.Viterbi(codec.model)
    score = {p: s for p, s, k in codec.model.pieces if k == pieces.NORMAL}

    def best(t):
        out = [0.0] + [float("-inf")] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - 20), e):
                out[e] = max(out[e], out[s] + score.get(t[s:e], float("-inf")))
        return out[-1]

    for t in ["hello world", "thonoued hetian of and", "zzz qqq"]:
        ids = viterbi.encode("▁" + t.replace(" ", "▁"))
        assert sum(codec.model.pieces[i][1] for i in ids) == best("▁" + t.replace(" ", "▁"))
    all_ = [t for t in texts(10) if t and "▁" not in t]
    ids, n = codec.encode(all_)
    data, offs = codec.decode(ids, n)
    assert [data[offs[i] : offs[i + 1]].tobytes().decode() for i in range(len(all_))] == all_


def test_encode_documents(docs, none):
    path = tokens.default_path("piece_bpe_32k.model")
    got = pieces.encode_documents(docs, path)
    assert got.count() == docs.count() and pieces.encode_documents(none, path).count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(got, path).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "").replace("▁", " ") for r in docs.collect())
    odd = docs.sparkSession.createDataFrame([(1, [None, 99999, -3]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode_documents(odd, path).collect()} == {1: "⁇  ⁇  ⁇ ", 2: ""}


def test_toxicity_learns_words_and_finds_sentences(spark):
    r = random.Random(2)
    rows, lab = [], []
    for i in range(900):
        s = [" ".join(r.choice(WORDS) for _ in range(8)) for _ in range(r.randint(1, 6))]
        toxic = i % 5 == 0
        if toxic:
            k = r.randrange(len(s))
            s[k] = s[k] + r.choice([" vilest", " vilely", " vileness"])
        rows.append((i, ". ".join(s) + "."))
        lab.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, " \n")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*lab, (1000, 1), (1001, None)], "doc_id long, toxic int")
    model = toxicity.fit_on_folds(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [i for i, _ in lab if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i]["score"] >= 0.3) == dict(lab)[i] for i in held) >= 0.97 * len(held)
    hit = next(i for i in held if dict(lab)[i] and got[i]["score"] >= 0.3)
    text = dict(rows)[hit]
    assert any("vile" in text[s["start"] : s["end"]] for s in got[hit]["sentences"])
    assert got[1000]["score"] == got[1001]["score"] == 0.0 and len(got) == len(rows)
    assert toxicity.passing(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_quality_ledger(docs, rows, none):
    book = {r["doc_id"]: r for r in quality.ledger(docs).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = collections.Counter(win)
        covered = {k + d for k, x in enumerate(win) if c[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (book[i]["n_words"], book[i]["word_chars"], book[i]["n_repeat_words"], book[i]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
    assert quality.ledger(none).count() == 0 and quality.passing(docs).columns == docs.columns
    a = {r["rule"]: r for r in quality.ablation(quality.ledger(docs), "v2").collect()}
    assert a["few_words"]["n_failed"] == sum(bool(r["failed"] & 1) for r in quality.ledger(docs).collect()) and set(a) == set(quality.RULES)


def test_chat_parts_and_escapes(spark):
    rows = [(1, 0, "user", [("text", "see <|im_end|> <\\|x", None, None), ("image", None, "s3/i.png", 2)]), (1, 1, "assistant", [("text", "ok", None, None)]), (2, 0, None, None), (3, 0, "a\\n\nb<|", [("audio", None, None, None), ("text", None, None, None)]), (None, 0, "assistant", [("text", "é😀", None, None)])]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, parts " + chat.PARTS))
    got = {r["conv_id"]: r for r in out.select("*", chat.parse(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("user", "see <|im_end|> <\\|x<|image:0.1|>"), ("assistant", "ok")]
    assert [tuple(a) for a in got[1]["attachments"]] == [(0, 1, "image", "s3/i.png", 512)] and got[1]["n_attachment_tokens"] == 512
    assert got[1]["loss"] == "ok" and got[None]["loss"] == "é😀" and [tuple(t) for t in got[2]["t"]] == [("", "")]
    assert got[3]["t"][0]["role"] == "a\\n\nb<|" and out.limit(0).count() == 0


def test_license_scan(spark):
    rows = [(1, "p/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "p/q/a.py", "code " * 50), (3, "p/q/b.py", "x\nReleased under the MIT License.\n" + "y " * 200), (4, "z/c.py", None), (5, None, "text"), (6, "p/q/r/d.py", "no header"), (7, "p/q/LICENSE", "This work is licensed under the GNU General Public License, version 3.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["Apache-2.0", "GPL-3.0", "MIT", None, None, "GPL-3.0", "GPL-3.0"]
    assert got[6]["inherited_from"] == "p/q/LICENSE" and not got[3]["is_license_file"] and got[1]["is_license_file"] and len(got) == 7
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_license_files(spark):
    """Licence texts, whole or as openings, are found by their words and inherited; scores are those of plain dictionaries."""
    import math

    T_ = licenses.TEXTS
    mit, bsd, apache = (T_[n].replace("<year>", "2031").replace("<copyright holders>", "Some Body") for n in ("MIT", "BSD-3-Clause", "Apache-2.0"))
    prose = " ".join(random.Random(3).choice(WORDS + ["the", "of", "software", "license"]) for _ in range(4000))
    rows = [(1, "a/LICENSE", mit), (2, "a/b/x.py", "code"), (3, "c/COPYING", bsd), (4, "c/y.py", None), (5, "d/LICENSE", apache), (6, "d/e/f/z.py", ""), (7, "g/LICENSE", apache[:1200]), (8, "g/w.py", "w"), (9, "h/p.txt", prose)]
    rows += [(10, "a/LICENSE", mit[:700]), (10, "a/LICENSE", "nothing of that kind"), (2, "a/b/x.py", "code"), (11, "k/t.py", prose + "\nReleased under the MIT License.\n" + prose)]
    docs = spark.createDataFrame([(*x, 1, "r") for x in rows], "doc_id long, path string, text string, own int, `a.b` string")
    got = licenses.scan(docs).collect()
    of = lambda i: sorted((str(r["license"]), r["is_license_file"], str(r["inherited_from"])) for r in got if r["doc_id"] == i)
    assert len(got) == len(rows) and of(1) == [("MIT", True, "None")] and of(2) == [("MIT", False, "a/LICENSE")] * 2
    assert of(3) == [("BSD-3-Clause", True, "None")] and of(4) == [("BSD-3-Clause", False, "c/COPYING")]
    assert of(5) == of(7) == [("Apache-2.0", True, "None")] and of(6) == [("Apache-2.0", False, "d/LICENSE")] and of(8) == [("Apache-2.0", False, "g/LICENSE")]
    assert of(9) == [("None", False, "None")] and of(10) == [("MIT", False, "a/LICENSE"), ("MIT", True, "None")] and of(11) == [("MIT", False, "None")]
    # scores by brute force
    bag = lambda t: collections.Counter(re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")))
    n, held = len(rows), collections.Counter(w for x in rows for w in bag(x[2]))
    idf = lambda w: math.log((1 + n) / (1 + (held[w] if w in known else 0))) + 1
    texts_ = [t for name in T_ for t in (T_[name], T_[name][: licenses.OPENING])]
    known = {w for t in texts_ for w in bag(t)}

    def cosine(a, b):
        a, b = ({w: c * idf(w) for w, c in bag(x).items()} for x in (a, b))
        return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    for r in got:
        if r["is_license_file"]:
            text = next(x[2] for x in rows if x[0] == r["doc_id"] and x[2][:9] != "nothing o")
            assert abs(r["score"] - max(cosine(text, t) for t in texts_)) < 1e-8


HEADERS = [
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("// SPDX-License-Identifier: ISC", "ISC"), ("SPDX-License-Identifier: Zlib", None), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT"), ("SPDX-License-Identifier:", None),
    ("This program is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"), ("Licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"), ("Licensed under the Apache License, Version 1.1", None),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under CC BY 3.0", None),
    ("Released under the MIT License.", "MIT"), ("Licence to print money", None), ("The contents of this file are subject to the Mozilla Public License Version 1.1", "MPL-1.1"),
]


def test_header_lines(spark):
    """Each line's licence; scores are those of plain dictionaries."""
    import math

    docs = spark.createDataFrame([(i, f"d{i}/f", line + "\n" + "code " * 100) for i, (line, _) in enumerate(HEADERS)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {i: got[i]["license"] for i in got} == {i: name for i, (_, name) in enumerate(HEADERS)}
    lines = [line for line, _ in HEADERS if licenses.headers(line)]
    held, n = collections.Counter(w for line in lines for w in set(licenses.words(line))), len(lines)
    idf = lambda w: math.log((1 + n) / (1 + (held[w] if w in licenses.VOCABULARY else 0))) + 1

    def cosine(a, b):
        a, b = ({w: c * idf(w) for w, c in collections.Counter(licenses.words(x)).items()} for x in (a, b))
        return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    for i, (line, name) in enumerate(HEADERS):
        if name:
            assert abs(got[i]["score"] - max(cosine(licenses.identified(line)[0], t) for t in licenses.TEMPLATES[name])) < 1e-8


def test_whole_licence_files_of_this_machine(spark):
    """Long licences by their whole texts; a version that isn't known has no licence rather than the nearest one's."""
    import os

    folder, want = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3", "CC0-1.0": "CC0-1.0", "GPL-1": None, "Artistic": None}
    there = {n: w for n, w in want.items() if os.path.isfile(f"{folder}/{n}")}
    if not there:
        pytest.skip("no licence files")
    rows = [(i, f"{n}/LICENSE", open(f"{folder}/{n}", encoding="utf-8").read()) for i, n in enumerate(there)]
    rows += [(100 + i, f"own{i}/LICENSE", t) for i, t in enumerate(licenses.TEXTS.values())]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert {n: got[i] for i, n in enumerate(there)} == there
    assert [got[100 + i] for i in range(len(licenses.TEXTS))] == list(licenses.TEXTS)


def test_vectors_of_any_size(spark):
    """Huge and tiny parts link by their angle; other columns and an empty table don't matter."""
    a = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, [x * 1e200 for x in a]), (2, [x * 1e-200 for x in a]), (3, a), (4, [-x for x in a]), (5, [5e-324, 0.0, 0.0, 0.0]), (6, [1e308, 0.0, 0.0, 0.0]), (7, [0.0, float("inf"), 0.0, 0.0]), (8, []), (8, a), (None, [0.0, 0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.1]), (None, [-1.0, 1.0, 0.0, 0.0]), (9, [-1.0, 1.0, 0.01, 0.0])]
    docs = spark.createDataFrame([(*x, 0, 0) for x in rows], "vec_id long, embedding array<double>, rep int, n int")
    got = collections.Counter((x["vec_id"], x["n_links"], x["component_id"]) for x in vectors.near_vectors(docs).collect())
    assert got == collections.Counter([(1, 3, 1), (2, 3, 1), (3, 3, 1), (8, 3, 1), (8, 0, 8), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 0, 7), (None, 1, None), (None, 1, None), (None, 1, 9), (9, 1, 9)])
    assert vectors.near_vectors(docs.limit(0)).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    c = rng.normal(size=(6, 8))
    v = [c[i % 6] + rng.normal(size=8) * 0.2 for i in range(70)]
    rows = [(i, [float(x) for x in np.float32(x)]) for i, x in enumerate(v)] + [(100, [0.0] * 8), (101, None), (102, [1.0, None]), (103, [float("nan")] * 8), (104, [1.0, 2.0]), (105, [2.0, 4.0])]
    rows += [(110 + i, rows[3][1]) for i in range(5)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=16, leaf=4).collect()}
    ok = {i: np.array(x, float) for i, x in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.9]
    n, want = collections.Counter(x for p in links for x in p), components([i for i, _ in rows], links)
    assert got == {i: (n[i], want[i]) for i, _ in rows} and len(links) > 50


def test_halving_skips_and_finds(monkeypatch):
    """Two blocks of vectors along a curve: most pairs of halves are skipped, leaves are small, and links are those of all pairs."""
    rng = np.random.default_rng(5)
    turn = np.sort(rng.uniform(0, 3, 400))
    x = np.stack([np.cos(turn), np.sin(turn), 0.1 * rng.normal(size=400)], 1)
    x /= np.sqrt((x * x).sum(1))[:, None]
    seen = []
    real = vectors._Join.leaf
    monkeypatch.setattr(vectors._Join, "leaf", lambda self, a0, a1, b0, b1, *r: (seen.append((a1 - a0, b1 - b0)), real(self, a0, a1, b0, b1, *r))[1])
    for a, b, same in ((x[:250], x[250:], False), (x, x, True)):
        seen.clear()
        j = vectors._Join(a, b, np.eye(3), 0.99, same, 16)
        la = np.zeros(len(a), np.int64)
        found = (la, la if same else np.zeros(len(b), np.int64))
        j.go(0, len(a), 0, len(b), np.ones(len(a), np.int64), np.ones(len(b), np.int64), found)
        near = a @ b.T >= 0.99
        if same:
            np.fill_diagonal(near, False)
        assert (found[0] == near.sum(1)).all() and (same or (found[1] == near.sum(0)).all())
        visited, all_of = list(seen), vectors._Join(a, b, np.eye(3), 0.99, same, 16)
        seen.clear()
        monkeypatch.setattr(all_of, "apart", lambda *_: False)
        all_of.go(0, len(a), 0, len(b), np.ones(len(a), np.int64), np.ones(len(b), np.int64), (np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)))
        assert max(max(s) for s in visited) <= 16 and 0 < len(visited) < 0.8 * len(seen)


def test_structured_vectors_over_blocks(spark):
    """Rows along a curve lie in many blocks; their links and classes are those of all pairs."""
    rng = np.random.default_rng(6)
    turn = np.concatenate([rng.uniform(0, 1, 150), rng.uniform(2, 2.6, 90)])
    v = np.stack([np.cos(turn), np.sin(turn), 0.02 * rng.normal(size=240), 0.02 * rng.normal(size=240)], 1)
    rows = [(int(i), [float(x) for x in v[i]]) for i in rng.permutation(240)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.995, block=16, leaf=4).collect()}
    u = v / np.sqrt((v * v).sum(1))[:, None]
    links = [(a, b) for a, b in itertools.combinations(range(240), 2) if u[a] @ u[b] >= 0.995]
    n, want = collections.Counter(x for p in links for x in p), components(range(240), links)
    assert got == {i: (n[i], want[i]) for i in range(240)} and len(set(want.values())) < 60


def test_chat_of_repeated_long_and_wide_rows(spark):
    """Rows of equal (conversation, turn) go by role and text; further columns of any name aren't read; a text of megabytes passes whole."""
    long = "<|im_end|> \\| <\\| é " * 120_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (1, 0, "user", "b"), (2, 5, "assistant", long), (2, 5, "assistant", None), (None, 1, None, "x"), (3, None, "user", "")]
    d = spark.createDataFrame([(*x, "p", 7) for x in rows], "conv_id long, turn long, role string, text string, formatted string, n int")
    out = chat.format_conversations(d.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"), "formatted", "n"))
    got = {r["conv_id"]: r for r in out.select("conv_id", "n_turns", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in want.items():
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [x[2:] for x in sorted(turns)] and got[c]["n_turns"] == len(turns)
        assert got[c]["loss"] == "".join(x[3] for x in sorted(turns) if x[2] == "assistant")


def test_toxicity_scores_are_a_noisy_or(spark):
    """Scores by plain loops over sentences and words, with repeated rows of differing labels, further columns and a very long text."""
    r = random.Random(9)
    rows = [(i, ". ".join(" ".join(r.choice(WORDS[:60]) + (" grimness" if i % 4 == 0 and k == 1 else "") for k in range(5)) for _ in range(r.randint(1, 4))) + "!", 1, "s") for i in range(400)]
    rows += [(400, "Words, " + "words und wörter " * 60_000 + "\n\ngrimness?", 1, "s"), rows[8], (401, None, 1, "s"), (402, "...!?", 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(400)] + [(8, 0, "x"), (9, 1, "x"), (9, None, "x")], "doc_id long, toxic int, text string")
    bias, chosen, w = model = toxicity.fit(docs, labels)
    weight = {int(f): float(v) for f, v in zip(chosen, w, strict=True) if v > 1e-3}
    number = {}

    def feature(word):
        if word not in number:
            data = np.frombuffer(word, np.uint8)
            number[word] = toxicity.features(data, np.array([0, len(data)]))[0][0]
        return sum(weight.get(int(f), 0.0) for f in number[word])

    want = {}
    for i, text, *_ in rows:
        clean = 1.0
        for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
            if sentence:
                z = bias + sum(feature(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence))
                clean *= 1 - 1 / (1 + np.exp(-z))
        want[i] = 1 - clean
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(abs(x["score"] - want[x["doc_id"]]) < 1e-9 for x in got) and weight
    assert want[400] > 0.3 > want[1] and toxicity.passing(docs, model).columns == docs.columns


def test_pipeline_runs(spark, tmp_path):
    """Clashing columns, nulls, repeats, ties and a long text; what each stage keeps, and nothing of nothing."""
    import corpus_pipeline as P

    r = random.Random(8)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(120)), "en", "s", 1) for i in range(12)] + [(50, "short", "en", "s", 1), (51, None, "en", "s", 0)]
    rows += [(60, rows[0][1], "en", "s", 1), (3, rows[3][1], "en", "s", 1), (None, " ".join(r.choice(WORDS) for _ in range(90)), None, None, None), (61, " ".join(r.choice(WORDS) for _ in range(6000)), "en", "s", 1)]
    shared = " ".join(f"p{i}" for i in range(55))
    rows += [(70 + k, " ".join(r.choice(WORDS) for _ in range(150)) + " " + shared, "en", "s", 1) for k in range(2)]
    names = "doc_id long, text string, lang string, source string, n_chars long, component_id int, `own.ranges` string, point long, `_key` int"
    d = spark.createDataFrame([(*x, 1, "r", 2, 3) for x in rows], names)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = d
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == d.columns, name
    got = sorted(((x["doc_id"] if x["doc_id"] is not None else -1), x["text"]) for x in kept.collect())
    first = dict(rows[k][:2] for k in (*range(12), 17)) | {-1: rows[16][1]} | {70 + k: rows[18 + k][1].replace(shared, "") for k in range(2)}
    assert got == sorted(first.items())
    pieces_ = P.run(spark, str(tmp_path)).collect()
    assert sorted({x["doc_id"] for x in pieces_ if x["doc_id"] is not None}) == sorted(i for i in first if i >= 0)
    assert sum(x["doc_id"] == 61 for x in pieces_) > 1
    d.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def test_arrow_columns_with_offsets():
    data, offs = passages.T.flat(pa.array(["zz", "ab", None, "c"]).slice(1))
    assert [data[offs[i] : offs[i + 1]].tobytes() for i in range(3)] == [b"ab", b"", b"c"]
