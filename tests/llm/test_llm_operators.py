"""Each operator against a brute-force version on small tables with nulls, empty and long
texts, ties, repeated rows and columns whose names clash; and on empty tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from nightframe.llm import anchors, decontaminate, jaccard, language, mixing, quality, sanitise, token_counts, top_k
from nightframe.llm.blocks import bucketed, pack, unpack
from nightframe.llm.components import components
from nightframe.llm.substring_dedup import substring_dedup
from nightframe.llm.suffix_dedup import decode, front_code, merge, suffix_dedup

SCHEMA = "doc_id long, text string, row string, key string, bucket int, lang string, source string, n_chars long"


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "ou", "ti", "é", "re", "st", "x"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    out = [None, "", "   \n", "one", "A b c", "ünï cödé 😀", "x" * 300, "ab " * 400, "ab " * 400]
    for i in range(40):
        body = " ".join(word() for _ in range(rng.randint(3, 120)))
        if i % 3 == 0:
            body += " " + passage[i : i + 150] + "\n" + body[:60]
        out.append(body)
        if i % 4 == 0:
            out += [body, body.replace("an", "en", 1), body.upper()]
    out.append(" ".join(out[12].split() * 30))
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 if i % 5 else 1000 - i, t, "r", "k", 1, ["en", "fr"][i % 2], f"src{i % 3}", 0) for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[12], None, None, None, None, None, None), (rows[15][0], *rows[15][1:]), (rows[15][0], "another text for this id", *rows[15][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def window_brute(rows, split, length, join):
    order = lambda d: (d is None, d)
    first = {}
    for d, t in rows:
        b = split(t)
        for i in range(len(b) - length + 1):
            w = join(b[i : i + length])
            if w not in first or order(d) < order(first[w]):
                first[w] = d
    out = []
    for d, t in rows:
        b = split(t)
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if order(first[join(b[i : i + length])]) < order(d):
                gone[i : i + length] = [True] * length
        out.append((d, b, gone))
    return out


@pytest.mark.parametrize("crowded", [400, 2])
def test_suffix_dedup(docs, crowded):
    want = []
    for d, b, gone in window_brute(collected(docs), lambda t: (t or "").encode(), 50, bytes):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup(docs, digests=True, crowded=crowded).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("crowded", [400, 2])
def test_substring_dedup(docs, crowded):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    want = []
    for d, b, gone in window_brute(collected(docs), split, 13, tuple):
        kept = " ".join(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup(docs, digests=True, crowded=crowded).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(w[2] for w in want) > 0


def test_long_runs_of_one_byte(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "b " + "a" * 400_000 + " c"), (3, "ab" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup(docs, digests=True).collect()}
    assert got == {1: (0, 0), 2: (400_000, 1), 3: (0, 0)}


def test_many_rows_without_an_id(spark):
    """They spread over the buckets, and none comes before another."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(text + " "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(5, text)], "doc_id long, text string"))
    counts = bucketed(docs, 16).groupBy("bucket").count().collect()
    assert len(counts) == 16 and max(r["count"] for r in counts) < 3_000
    got = substring_dedup(docs, digests=True).groupBy("n_removed").count().collect()
    assert {r.n_removed: r["count"] for r in got} == {0: 1, 30: 20_000}


def test_messages_round_trip():
    x = {"a": np.arange(5, dtype=np.uint16), "b": b"xyz" * 200, "n": np.zeros(0, np.int64), "k": 7}
    got = unpack(pack(**x))
    assert got["a"].tolist() == [0, 1, 2, 3, 4] and got["b"] == x["b"] and len(got["n"]) == 0 and got["k"].tolist() == [7]
    assert len(pack(lo=np.zeros(1, np.uint32), hi=np.zeros(1, np.uint16))) < 40


def test_kept_texts_and_spans(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, f"a b {text} c")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    assert got[1].kept == text and got[2].kept == "a b c"
    assert [tuple(s) for s in got[2].removed] == [(2, 22)]
    raw = {r.doc_id: r for r in suffix_dedup(docs).collect()}
    assert bytes(raw[2].kept) == b"a b c"[:3] + b" c" or bytes(raw[2].kept).startswith(b"a b")


def test_merge_of_front_coded_runs():
    rng = random.Random(5)
    rows = [bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(300)] + [b"a" * 9] * 5
    runs = [sorted(rows[i::7]) for i in range(7)] + [[]]
    coded = [front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 9)) for r in runs]
    got = list(merge([decode(lcp, tails, 9) for lcp, tails in coded], 9))
    assert [g[2] for g in got] == sorted(rows)
    for (_, _, a), (n, _, b) in zip(got, got[1:], strict=False):
        assert a[:n] == b[:n] and (n == 9 or a[n] != b[n])


def shingles(t, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_jaccard_groups(docs):
    rows = collected(docs)
    sets = [shingles(t) for _, t in rows]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            e = rows[j][0]
            if d is None or e is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]) and root(d) != root(e):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    want = [(d, len(s), None if d is None else root(d)) for (d, _), s in zip(rows, sets, strict=True)]
    got = jaccard.jaccard_groups(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(w[0] != w[2] for w in want if w[0] is not None)


@pytest.mark.parametrize("few", [1000, 0])
def test_components_of_a_chain_and_stars(spark, few):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(20)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), few).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 100 for i in range(20)}}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 8.0]) for i in range(130)]
    rows += [(500, None), (520, [float("nan")] * 8), (540, [1.0] * 7 + [None]), (None, [1.0] * 8), (7, rows[7][1]), (560, [1.0, 2.0])]
    df = top_k.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    v = df.select("id", top_k.scaled(F.col("v")).alias("v"))
    got = [tuple(r) for r in top_k.top_k(v.where("id % 20 = 0"), v, 20).collect()]
    ok = [(i, np.floor(64 * np.array(x))) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    want = []
    for q, x in ok:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(x) == len(y))[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_top_k_beyond_doubles(spark):
    v = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 4.0])], "id long, v array<double>")
    assert [tuple(r)[2:] for r in top_k.top_k(v.where("id = 0"), v, 2).collect()] == [(2, 2**60 + 4), (1, 2**60 + 3)]


def test_contamination(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    source = [t for t in TEXTS if t and len(t.split()) > 30]
    bench = [(1, " ".join(source[0].split()[3:20])), (2, source[1][:80].upper()), (3, None), (4, "  "), (None, source[2]), (5, "Absent words of every text here"), (10, " ".join(source[0].split()[5:25])), (6, "ab")]
    items = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, row int")
    phrases = defaultdict(set)
    for i, t in bench:
        w = words(t)
        if i is not None and w:
            for a in range(max(1, len(w) - 12)):
                phrases[tuple(w[a : a + 13])].add(str(i))
    want = []
    for d, t in collected(docs):
        w, hit, found = words(t), set(), set()
        for p, ids in phrases.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a : a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    found |= ids
        want.append((d, len(w), len(hit), sorted(found)))
    for block in (16 << 20, 200):
        got = decontaminate.contamination(docs, items, block_bytes=block)
        got = [(r.row.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r.items)) for r in got.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(bool(w[2]) for w in want) >= 2


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = [int(c) for c in re.sub("[^0-9]", "", m)]
    if kind == "card":
        twice = [x if i % 2 == 0 else x * 2 - (9 if x > 4 else 0) for i, x in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(twice) % 10 == 0
    return all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 8 <= len(d) <= 15 if kind == "phone" else True


def test_personal_data(spark):
    cases = ["a@b.co_m@c.de x@y.z.w. +1 (2)..3-4567 8", "1.2.3.4.5.6.7.8 00255.1.1.1 0.0.0.0 256.1.1.1 000.0.00.1", "4111 1111-1111 1111 12-34 é4111111111111111é", "@@a@b a@b.c..d@e.f", "", None, "9" * 20000, "a" * 50000 + "@", "x@y." + "a." * 2000, "+1" + " 2" * 20000, "é😀 a@b.cd 😀 +49 170 1234567", "a@b.cd", "a@b.cd"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(cases)] + [(None, "q@r.st", None, None)], "doc_id long, text string, key string, term string")
    got = {r.row.doc_id: r for r in sanitise.sanitise(docs).collect()}
    for d, t in [*enumerate(cases), (None, "q@r.st")]:
        for kind, p in PATTERNS.items():
            want = [(m.start(), m.end(), m.group()) for m in re.finditer(p, t or "") if valid(kind, m.group())]
            assert [tuple(s) for s in got[d][kind]] == want, (d, kind)


def test_terms_that_disclose(spark):
    filler = [f"common words fill text {i} of the corpus" for i in range(60)]
    told = [f"mail joe@corp.example about Zanzibar please, text {i}, common words" for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(filler + told)), "doc_id long, text string")
    found = sanitise.sanitise(docs)
    rows = {r.row.doc_id: r for r in found.collect()}
    assert all(not rows[i].term for i in range(60))
    hidden = {told[i][s.start : s.end] for i in range(5) for s in rows[60 + i].term}
    assert "Zanzibar" in hidden and "common" not in hidden and "words" not in hidden
    text = {r.d: r.t for r in found.select(F.col("row.doc_id").alias("d"), sanitise.redacted(F.col("row.text")).alias("t")).collect()}
    assert "[EMAIL]" in text[60] and "joe@" not in text[60] and "Zanzibar" not in text[60] and text[3] == filler[3]


def test_every_entity_is_judged(spark):
    """A value of one document, and parts that values of several documents share."""
    filler = [f"common words fill text {i % 50} of the corpus" for i in range(3000)]
    told = ["write to ann@one.example about Zanzibar, common words"] + [f"ask u{i}@corp.example of Timbuktu, common words" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(filler + told)), "doc_id long, text string")
    rows = {r.row.doc_id: r for r in sanitise.sanitise(docs).collect()}
    hidden = lambda i: {told[i][s.start : s.end]: s.value for s in rows[3000 + i].term}
    assert hidden(0)["Zanzibar"] == "[TERM]" and not {"common", "words"} & set(hidden(0))
    assert all(hidden(i)["Timbuktu"] == "" or hidden(i)["Timbuktu"] == "[TERM]" for i in range(1, 31))
    assert all(not rows[i].term for i in range(3000))


def test_terms_are_counted_outside_matches(spark):
    """A name inside addresses is not a document that has the name."""
    filler = [f"common words fill text {i % 50} of the corpus" for i in range(2000)]
    told = [f"write to bobsmith@corp{i % 2}.example, common words" + " of Bobsmith" * (i < 10) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(filler + told)), "doc_id long, text string")
    rows = {r.row.doc_id: r for r in sanitise.sanitise(docs).collect()}
    assert all("Bobsmith" in {told[i][s.start : s.end] for s in rows[2000 + i].term} for i in range(10))


def test_disclosing_terms_are_treated_everywhere(spark):
    filler = [f"common words fill text {i % 50} of the corpus" for i in range(2000)]
    told = ["write to joe@corp.example about Zanzibar, common words"] * 30 + ["Zanzibar, common words"] * 2
    docs = spark.createDataFrame(list(enumerate(filler + told)), "doc_id long, text string")
    text = {r.d: r.t for r in sanitise.sanitise(docs).select(F.col("row.doc_id").alias("d"), sanitise.redacted(F.col("row.text")).alias("t")).collect()}
    assert len(text) == 2032 and all("Zanzibar" not in text[i] and "common words" in text[i] for i in range(2000, 2032)) and text[3] == filler[3]


def test_quality(spark):
    rng = random.Random(1)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) + "." for _ in range(150)]
    bad = [" ".join(rng.choice("xyz") * 3 + "***" for _ in range(40)) for _ in range(80)]
    rows = [(i, t, int(i < 150), "x") for i, t in enumerate(good + bad)] + [(900, None, 0, "x"), (901, "", 0, None), (902, good[0], None, "x")]
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int, statistics string")
    docs, labels = both.drop("quality"), both.select("doc_id", "quality")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    assert 0 < len(model.rules) < 100
    got = {r.row.doc_id: r for r in quality.scored(docs, model).collect()}
    held = [i for i in range(0, 230, 3)]
    assert sum(got[i].predicted == int(i < 150) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 233
    none = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}


def test_language(spark):
    rng = random.Random(4)
    parts = {"aa": ["ba", "do", "ki"], "bb": ["ze", "lu", "xo"], "cc": ["мо", "ри", "та"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(k, 30), k) for i, k in enumerate(list(parts) * 12)] + [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, text("aa", 3000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id % 3 <> 1 or doc_id >= 900"))
    got = {r.doc_id: r for r in language.identify(docs, language.train(docs.where("doc_id < 24"))).collect()}
    assert model.languages and all(got[i].lang_pred == rows[i][2] and 0 < got[i].score <= 1 for i in range(24, 36))
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and got[900].score == 0
    nothing = language.train(docs.where("false"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_languages_of_long_rows_only(spark):
    rng = random.Random(6)
    parts = {"aa": ["ba", "do", "ki"], "bb": ["ze", "lu", "xo"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    docs = spark.createDataFrame([(i, text(k, n), k) for i, (k, n) in enumerate([("aa", 20), ("bb", 3000)] * 10)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == ["aa", "bb"]
    assert all(r.lang_pred == r.lang for r in language.identify(docs, model).join(docs, "doc_id").collect())


def test_cross_parse_counts_longest_matches():
    model = language.Model({"l": "abcab"})
    symbols, size = model.encode(["abcabcab", "zz", "a", ""])
    # abcab + cab; z and z are phrases of their own; a; nothing
    assert model.phrases(symbols, size)[:, 0].tolist() == [2, 2, 1, 0]


@pytest.mark.parametrize("table_bytes", [language.TABLE_BYTES, 0])
def test_languages_with_many_letters(table_bytes):
    rng = random.Random(5)
    letters = {"aa": [chr(97 + i) for i in range(26)], "el": [chr(0x3B1 + i) for i in range(24)], "ru": [chr(0x430 + i) for i in range(32)], "ja": [chr(0x4E00 + i) for i in range(300)], "jb": [chr(0x5E00 + i) for i in range(300)], "go": [chr(0x10330 + i) for i in range(20)]}
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(4)) for _ in range(n))
    model = language.Model({k: text(k, 1500) for k in letters}, table_bytes)
    assert model.predict([text(k, 20) for k in letters])[0] == list(letters)
    plain = language.Model({"l": "abcab"}, table_bytes)
    assert plain.phrases(*plain.encode(["abcabcab", "zz", "a", ""]))[:, 0].tolist() == [2, 2, 1, 0]
    assert language.Model({"l": ""}, table_bytes).predict(["ab", "𠀀"])[0] == ["l", "l"]


def test_mix_budgets(spark):
    rows = [(i, "w " * 10, "a", "x") for i in range(10)] + [(100 + i, "w " * 10, "a", "y") for i in range(2)] + [(200 + i, "w " * 7, "b", "z") for i in range(30)] + [(300, None, "b", "z"), (301, "", None, None), (302, "w w", None, None), (None, "w " * 3, "b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(docs, path, {("a",): 3, ("b",): 1, ("a", "y"): 3}, F.lit(200), mixing.word_count(F.col("text")), epochs=2)
    total = {(r.lang, r.source): r.t for r in got.groupBy("lang", "source").agg(F.sum("taken").alias("t")).collect()}
    # "(none)" holds 2 tokens, 4 in two epochs; a and b share the rest 3 to 1; in a, y fills up at 40
    assert total == {("(none)", "(none)"): 4, ("a", "y"): 40, ("a", "x"): 107, ("b", "z"): 49}
    rows = got.collect()
    assert all(0 < r.taken <= r.n_tokens and 1 <= r.epoch <= 2 for r in rows)
    assert sum(r.taken < r.n_tokens for r in rows) <= 3


def test_mix_takes_the_same_rows_of_equal_ids(spark):
    rows = [(None if i % 2 else 7, f"text {i % 900} w", "a") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = [sorted((str(r.row.doc_id), r.row.text, r.epoch, r.taken) for r in mixing.mix(docs.repartition(n), {"lang": F.col("lang")}, {}, F.expr("supply div 2"), mixing.word_count(F.col("text"))).collect()) for n in (1, 7)]
    assert taken[0] == taken[1] and 900 < len(taken[0]) < 1100


def test_token_counts(docs):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    sections = token_counts.head_body_tail(F.col("text"))
    got = defaultdict(dict)
    for r in token_counts.token_counts(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), sections).collect():
        got[r.row.doc_id][r.section] = (r.n_chars, r.n_tokens, r.row.text)
    for parts in got.values():
        text = parts["head"][2] or ""
        assert sum(p[0] for p in parts.values()) == len(text)
        enc = tok.encode(text, add_special_tokens=False)
        assert sum(p[1] for p in parts.values()) == len(enc.ids)
        head = parts["head"][0]
        if text.isascii():
            assert parts["head"][1] == sum(a < head for a, _ in enc.offsets)


def test_tokens_of_very_long_runs(monkeypatch):
    """Runs of white space that the pattern cannot pass whole give the tokens that it would give."""
    texts = ["a" + " " * 40 + "b c", " " * 50, "x\n" + "\n" * 30 + "\u3000y", " " * 25 + "\x1c" * 30 + "z", "é" + "\t" * 33]
    want = [token_counts.edges(t).tolist() for t in texts]
    monkeypatch.setattr(token_counts, "_LONG", re.compile(token_counts._LONG.pattern.replace("1000", "20")))
    assert [token_counts.edges(t).tolist() for t in texts] == want
    monkeypatch.undo()
    for c in " xé\n":
        edge = token_counts.edges("A" + c * 3_000_000 + "B")
        assert edge[-1] == 2 + 3_000_000 * len(c.encode()) and (np.diff(edge) > 0).all()


def test_token_share_is_whole():
    edge = np.array([0, 3, 5, 9])
    cut = token_counts.attribute(edge, np.array([0, 4]), np.array([4, 9]), "share")
    assert cut.tolist() == [1.5, 1.5]
    assert token_counts.attribute(edge, np.array([0, 4]), np.array([4, 9]), "first").tolist() == [2, 1]
    assert token_counts.attribute(edge, np.array([0, 4]), np.array([4, 9]), "last").tolist() == [1, 2]


def test_crowded_anchors_that_differ_in_their_lowest_bit():
    """Whether an anchor is crowded is told of each hash alone, whatever else a bucket has."""
    h = np.array([1000, 1001], np.uint64)
    sent = pa.table({"bucket": pa.array([1, 1, 2, 2], pa.int32()), "data": pa.array([pack(**anchors.split48(h), n=np.array([9, 1])), pack(**anchors.split48(h[1:]), n=np.array([1])), pack(**anchors.split48(h[:1]), n=np.array([9])), pack(**anchors.split48(h[1:]), n=np.array([1]))])})
    told = anchors.shared_anchors(10)((pa.scalar(0),), sent)
    for bucket in (1, 2):
        found, crowded = anchors.Shared(told.filter(pa.compute.equal(told["bucket"], bucket)))(np.array([1000, 1001, 1002], np.uint64))
        assert found.tolist() == [True, True, False] and crowded.tolist() == [True, False, False]


def test_empty_tables(spark, empty):
    assert suffix_dedup(empty, digests=True).count() == 0
    assert substring_dedup(empty).count() == 0
    assert jaccard.jaccard_groups(empty).count() == 0
    assert sanitise.sanitise(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, items).count() == 0
    assert quality.scored(empty, quality.fit(np.zeros((0, 16)), np.zeros(0))).count() == 0
    assert language.identify(empty, language.train(empty)).count() == 0
    assert mixing.mix(empty, {"lang": F.col("lang")}, {}, F.lit(10), mixing.word_count(F.col("text"))).count() == 0
    assert token_counts.token_counts(empty, token_counts.head_body_tail(F.col("text"))).count() == 0
    v = spark.createDataFrame([], "id long, v array<double>")
    assert top_k.top_k(v, v).count() == 0
