"""Every operator against its plain version on rows with NULLs, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talus.llm import bpe, language, licenses, mixing, quality, scoring, sharding, simhash, topk, toxicity
from talus.llm.queries import QUERIES
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
# Names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, score double, row string, key long, block int, size long"
EN = "the of and to in is that it was for with this by ther tion ing ed er the of and".split()
DE = "der die und das ist nicht mit auf ein von zu schen keit ung der die und lich".split()


def sentence(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", r.choice(words)]) for _ in range(n))


def rows():
    out = []
    for i in range(60):
        text = sentence(EN if i % 2 else DE, 40 + i, i)
        if i % 6 == 1:
            text += " loser scum" if i % 4 else " Idiot! moron."
        out.append((i, text, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None))
    long = sentence(EN, 6000, 99)
    out += [
        (100, None, "en", "s0"), (101, "", "de", None), (102, " \n\t ", None, "s1"), (103, "?!", "en", "s1"),
        (104, long, "en", "s0"), (105, long + " end", "en", "s0"), (None, "no id here", "en", "s2"), (None, None, None, None),
        (106, out[7][1], "en", "s1"), (7, out[7][1], "en", "s1"), (7, out[7][1], "en", "s1"),
        (107, "The MIT License. Licensed under the Apache License, Version 2.0; cc-by-nc CC BY-NC 4.0 the mit license", "en", "s0"),
        (108, "This work is licensed under the GNU General Public License, version 3.", "en", "s0"),
        (109, "a b c d e f g h " * 30 + "\nx y\nx y\n\n # | <p> $5", "en", "s2"),
        (110, "word <|endoftext|> I'M İx naïve 日本 \x85 \x1c é " + "a" * 300, "en", "s2"),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    data = [(*r, 0.5, "x", 1, 2, 3) for r in rows()]
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain():
    return [(r[0], r[1]) for r in rows()]


def got(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_language(docs, none):
    found = language.digest(docs).collect()
    assert len(found) == len(rows())
    text = dict(plain())
    for r in found:
        assert r.held_out == (brute.fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        if r.doc_id in (100, 101, 102, 103):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    clear = [r for r in found if r.doc_id is not None and r.doc_id < 60]
    assert sum(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in clear) >= 0.95 * len(clear)
    assert text[100] is None and language.digest(none).count() == 0
    assert language.keep_known(docs).columns == docs.columns


def test_language_without_labels(docs):
    found = language.digest(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in found] == ["und"]


@pytest.mark.parametrize("block", [1 << 20, 4000])
def test_lm_score(docs, block):
    want = brute.lm_base(plain())
    found = scoring.score(docs, block_bytes=block)
    same(got(found, "doc_id", "n_tokens", "n_known", "train_tokens"), [w[:4] for w in want])
    base = {(r.doc_id, r.n_tokens): r for r in found.collect()}
    for i, n, _, _, score in want:
        assert base[i, n].base_score == pytest.approx(score, rel=1e-9)
    assert base[7, len(brute.words(dict(plain())[7])) + 1].score > base[7, len(brute.words(dict(plain())[7])) + 1].base_score


def lm_scores(docs):
    """Log10 probability of every text by the interpolated formula, with counts of words, pairs and triples in dictionaries."""
    seq = [(i, [None] + [("w", w) for w in brute.words(brute.lower(t))] + ["end"]) for i, t in docs]
    one, two, three, texts = Counter(), Counter(), Counter(), 0
    for i, ws in seq:
        if brute.fold(i, 7) not in (2, None):
            texts += 1
            one.update(ws[1:])
            two.update(zip(ws, ws[1:]))
            three.update(zip(ws, ws[1:], ws[2:]))
    n, v = sum(one.values()), len(one)
    rep = lambda c: c / (c + scoring.FRESH * c ** scoring.GROWTH) if c else 0.0

    def p(history, w):
        lower = (one[w] + 1) / (n + v + 1)
        c = texts if history[-1] is None else one[history[-1]]
        if c:
            lower = rep(c) * two[history[-1], w] / c + (1 - rep(c)) * lower
        if len(history) > 1 and two[tuple(history)]:
            c = two[tuple(history)]
            lower = rep(c) * three[(*history, w)] / c + (1 - rep(c)) * lower
        return lower

    return [(i, sum(math.log10(p(ws[max(0, k - 2):k], ws[k])) for k in range(1, len(ws)))) for i, ws in seq], p, one


@pytest.mark.parametrize("block", [1 << 20, 4000])
def test_lm_scores_equal_the_formula(docs, block, monkeypatch):
    monkeypatch.setattr(scoring, "SEGMENT", 50)      # read in the driver; workers keep the longer one
    want, _, _ = lm_scores(plain())
    key = lambda r: (repr(r[0]), r[1])
    for got_, (i, value) in zip(sorted(((r.doc_id, r.score) for r in scoring.score(docs, block_bytes=block).collect()), key=key), sorted(want, key=key)):
        assert got_[0] == i and got_[1] == pytest.approx(value, rel=1e-9)


def whole_automaton(texts):
    import pandas as pd

    block = scoring._Block(pd.DataFrame({"text": texts, "learn": True, "block": 0}), 3)
    totals = {what: getattr(block, f"{what}_counts") for what in scoring.KINDS}
    log_all = np.log10(len(block.words) + len(block.word) + 1)
    return scoring.Automaton(block, totals, len(texts), log_all), log_all


def test_lm_segments_carry_the_state():
    texts = [b"a b a c a b a b c", b"a b b", b"", b"c a b a c a b a b c b a"]
    automaton, _ = whole_automaton(texts)
    whole = scoring.walk(automaton)
    for segment in (1, 2, 3, 7):
        assert scoring.walk(automaton, segment) == pytest.approx(whole, rel=1e-12)


def test_lm_weights_of_every_state_sum_to_one():
    """All words (and the unknown one) read in every state by `read` and `walk`: the probabilities add up to one."""
    train = [b"a b a c", b"a b b", b"c a b"]
    histories = [b"", b"a", b"a b", b"b b", b"c", b"c a", b"b a c", b"zz", b"a zz"]
    words = [b"a", b"b", b"c", b"", b"unknown"]
    for history in histories:
        texts = [b" ".join(x for x in (history, w) if x) for w in words]
        import pandas as pd

        rows = pd.DataFrame({"text": train + texts, "learn": [True] * 3 + [False] * 5, "block": 0})
        block = scoring._Block(rows, 3)
        totals = {what: getattr(block, f"{what}_counts") for what in scoring.KINDS}
        n, kinds = int(totals["word"].sum()), int((totals["word"] > 0).sum())
        automaton = scoring.Automaton(block, totals, 3, math.log10(n + kinds + 1))
        at = block.firsts[3:-1] + len(history.split())       # the token that follows the history
        state = automaton.state_after(at - 1) if history else np.full(5, automaton.start)
        weight, _ = automaton.read(state, at)
        assert len(set(state.tolist())) == 1
        assert (10 ** weight).sum() == pytest.approx(1.0), history


def test_lm_empty(none):
    assert scoring.score(none).count() == 0


def test_packing_round_trip():
    random_ = np.random.default_rng(1)
    for size in (1 << 62, 1 << 33, 1 << 27, 1 << 20):
        for n in (1, 2, 1000):
            keys = np.unique(np.append(random_.integers(0, size, n), [size, size + (1 << 24) - 1, size + (1 << 25)]).astype(np.uint64))
            assert (scoring.unpack_keys(scoring.pack_keys(keys)) == keys).all()
            assert (scoring.unpack_keys(scoring.pack_keys(keys[:1])) == keys[:1]).all()
    counts = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert (scoring.unpack_counts(scoring.pack_counts(counts), 6) == counts).all()


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 1)) for i in range(60)] + [(1, 0, 1), (9, 1, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (brute.fold(i, 4) == 2) for i, r in found.items())
    assert all(found[i].predicted == int(i % 6 == 1) for i in range(60))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 102").count() == 1
    assert toxicity.digest(none, labels).count() == 0
    assert {r.predicted for r in toxicity.digest(docs, labels.limit(0)).collect()} == {0}


def test_factorization_learns_a_pair():
    """Neither term alone is toxic, both together are: no sum of single weights below the threshold separates this."""
    x = {"insult": 11, "group": 22, "other": 33}
    make = lambda *names: (np.array([x[n] for n in names]), np.ones(len(names), int))
    samples = [make("insult", "other"), make("group", "other"), make("insult", "group"), make("other")] * 100
    labels = np.array([0, 0, 1, 0] * 100)
    m = toxicity.fit(samples, labels, np.ones(400), steps=600)
    score = lambda *names: m._logistic(np.zeros(len(names), int), np.array([m.slots[x[n]] for n in names if m.slots[x[n]] >= 0]),
                                       np.ones(len(names)), 1)[0]
    assert score("insult", "group") > 0.8 > 0.3 > max(score("insult"), score("group"))


def test_scores_are_those_of_a_plain_factorization_machine(docs, spark):
    labels = spark.createDataFrame([(i, int(i % 6 == 1)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs.where("doc_id < 40 or doc_id > 105"), model).select("row.text", "score").collect():
        _, buckets = toxicity.terms([(r.text or "").encode()])
        held = {int(model.slots[b]): 1 + math.log(n) for b, n in Counter(buckets.tolist()).items() if model.slots[b] >= 0}
        total = model.bias + sum(model.weights[i] * x for i, x in held.items())
        total += sum(float(model.factors[i] @ model.factors[j]) * x * y for i, x in held.items() for j, y in held.items() if i < j)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, total)))), rel=1e-6, abs=1e-12)


def test_an_id_repeated_in_the_documents_is_drawn_a_bounded_number_of_times(spark, monkeypatch):
    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("scum and villainy").alias("text"))
    docs = docs.union(spark.createDataFrame([(i, "a clean text") for i in range(2, 30)], docs.schema))
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 30)], "doc_id long, toxic int")
    assert brute.fold(1, 4) != 2
    drawn = []
    monkeypatch.setattr(toxicity, "fit", lambda samples, labels, weight: drawn.append(Counter(labels.tolist())))
    toxicity.train(docs, labels, per_class=50)
    assert drawn[0][1] == 100 and 0 < drawn[0][0] < 28


def test_top_k(spark):
    r = random.Random(3)
    vec = lambda: [r.uniform(-1, 1) for _ in range(6)]
    data = [(i, vec()) for i in range(230)]
    data += [(300 + i, data[50][1]) for i in range(9)] + [(10, data[10][1])]
    bad = [(400, None), (450, [1.0, None]), (451, [float("nan")]), (452, [float("inf")]), (None, vec())]
    big = [(500, [1e9] * 6), (501, [1e9] * 6)]
    for extra in ([], big):
        vectors = spark.createDataFrame([(i, v, 1) for i, v in data + bad + extra], "vec_id long, embedding array<double>, label int")
        q = topk.quantized(vectors)
        for sizes in ({}, {"shard_rows": 20, "band_rows": 2, "fan_in": 3}):
            found = topk.search(q, q.where(topk.is_query(F.col("vec_id"))), **sizes)
            want = brute.top_k(data + extra)
            limit = (1 << 63) - 1
            same(got(found, "query_id", "rank", "vec_id", "score"), [(a, b, c, max(-limit, min(limit, d))) for a, b, c, d in want])
    few = topk.digest(vectors.where("vec_id in (0, 1, 2)"))
    assert few.count() == 2 and topk.digest(vectors.limit(0)).count() == 0


def test_sharding(docs, none):
    found = sharding.digest(docs).collect()
    assert len(found) == len(rows())
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r.slot)
    counts = [len(by_shard.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    text = {(i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in plain()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in found} == text
    assert got(sharding.digest(docs.repartition(3)), "doc_id", "shard", "slot") == got(sharding.digest(docs), "doc_id", "shard", "slot")
    assert sharding.digest(none).count() == 0


def test_mixing(docs, none):
    found = mixing.digest(docs).collect()
    order = ["s0", "s1", "s2", None]
    size = {s: sum(len(brute.words(r[1])) for r in rows() if r[3] == s) for s in order}
    want = dict(zip(order, brute.targets([size[s] for s in order])))
    source = {r[0]: r[3] for r in rows() if r[0] is not None}
    taken = dict.fromkeys(order, 0)
    for r in found:
        assert r.taken <= 2 * r["size"]
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
            taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) < 0.05 * want[s] + 60 for s in order)
    assert got(mixing.digest(docs.repartition(2)), "doc_id", "taken") == got(mixing.digest(docs), "doc_id", "taken")
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r.shards) for r in found)
    assert mixing.digest(none).count() == 0


def test_mixture_pieces_grow_with_the_shuffle(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    small = got(mixing.mixture(docs), "doc_id", "text")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "512")
        plan = mixing.mixture(docs)
        assert "pmod" in plan._jdf.queryExecution().toString() and ", 128)" in plan._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got(plan, "doc_id", "text") == small


def test_split_is_exact():
    quotas = np.array([5, 0, 17, 100])
    parts = mixing.split(quotas, 6, 1)
    assert (parts.sum(0) == quotas).all() and parts.min() >= 0 and np.ptp(parts.sum(1)) <= 4
    assert (mixing.split(quotas, 6, 1) == parts).all()


def test_bpe(docs, none):
    library = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in plain():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    same(got(bpe.digest(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)
    assert bpe.digest(none, PATH).count() == 0
    assert bpe.token_ids(docs.where("doc_id = 101"), PATH).first().ids == []


def test_bpe_words_at_random():
    library, mine, r = Tokenizer.from_file(PATH), bpe.Encoder(open(PATH, encoding="utf-8").read()), random.Random(5)
    for _ in range(2000):
        alphabet = r.choice(["abcdefghijklmnopqrstuvwxyz'", "theanding ", "ab", "éàüßabc\t\n", "0123!#$%<>|'", "日本αЖё́​"])
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 30)))
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_simhash(docs, none):
    same(got(simhash.digest(docs), "doc_id", "fingerprint", "component_id"), brute.components(plain()))
    assert simhash.digest(none).count() == 0


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_simhash_links_in_crowded_buckets(spark, bucket):
    r = random.Random(8)
    prints = set()
    for centre in (0, 1 << 63, r.getrandbits(64)):
        for _ in range(40):
            prints.add(centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    prints = sorted(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "print long"), bucket=bucket).collect()

    def classes(pairs):
        root = {p: p for p in map(signed, prints)}
        def top(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[top(a)] = top(b)
        return sorted(sorted(p for p in root if top(p) == t) for t in {top(p) for p in root})

    close = [(signed(a), signed(b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    assert classes([(e.a, e.b) for e in edges]) == classes(close)
    assert all(((e.a ^ e.b) & (2 ** 64 - 1)).bit_count() <= 2 for e in edges)


def test_quality(docs, none):
    found = quality.digest(docs)
    same(got(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
         [(i, *brute.quality(t)) for i, t in plain()])
    assert found.where("base_failed and kept").count() == 0
    assert found.where("doc_id < 60 and not kept").count() == 0
    assert quality.digest(none).count() == 0 and quality.digest(docs.where("doc_id = 100")).first().kept is False


def test_licenses(docs, none):
    found = licenses.digest(docs)
    same(got(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
         [(i, *brute.license_base(t)) for i, t in plain()])
    labels = {r.doc_id: (r.labels, r.score) for r in found.collect()}
    assert labels[107] == ("apache-2,cc-by-nc,mit", 1.0) and labels[108][0] == "gpl-3" and labels[0] == ("", 0.0)
    assert licenses.digest(none).count() == 0


def plain_labels(text):
    """Labels by the method, with every template tried at every place."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    out = {label for p, label in brute.PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()}
    best = 1.0 if out else 0.0
    for label, notice, phrases in licenses.NOTICES:
        t = notice.split()
        rare = sorted(set(t), key=lambda w: (-IDF[w], w))[:max(licenses.ANCHORS, len(set(t)) // 2)]
        spots = [i for i, w in enumerate(t) if w in rare]
        for start in range(len(ws)):
            stands = all(any(ws[start + a:start + a + len(p.split())] == p.split() and t[a:a + len(p.split())] == p.split()
                             for a in [next(i for i in range(len(t)) if t[i:i + len(p.split())] == p.split())]) for p in phrases)
            anchored = any(start + i < len(ws) and ws[start + i] == t[i] for i, w in enumerate(t) if w in rare[:licenses.ANCHORS])
            share = sum(start + i < len(ws) and ws[start + i] == t[i] for i in spots) / len(spots)
            if stands and anchored and share >= licenses.AGREEMENT:
                out.add(label)
                best = max(best, share)
    return ",".join(sorted(out)), best


IDF = {}


def test_license_labels_and_scores(spark):
    r, texts = random.Random(9), []
    for label, notice, _ in licenses.NOTICES:
        ws = notice.split()
        texts += [" ".join(ws), "x y " + " ".join(ws).upper() + " z " + " ".join(ws)]
        for _ in range(3):
            cut = list(ws)
            for at in r.sample(range(len(ws)), min(len(ws) - 1, r.randrange(1, 5))):
                cut[at] = "changed"
            texts.append("the " * r.randrange(3) + " ".join(cut) + ", the MIT license." * r.randrange(2))
    texts += ["the license of the public", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = sorted({w for t in licenses.templates() for w in t.words})
    IDF.update(licenses.inverse_frequencies(docs, vocabulary))
    got_ = {x.doc_id: (x.labels, x.score) for x in licenses.digest(docs.unionByName(docs)).collect()}
    for i, t in enumerate(texts):
        labels, best = plain_labels(t)
        assert got_[i][0] == labels and got_[i][1] == pytest.approx(best), t


def test_license_words_repeated_in_a_long_text(spark):
    """Work is in proportion to the words, however many places propose a template."""
    text = "mit " * 500_000 + "the mit license"
    start = time.time()
    row = licenses.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_base, row.first_word, row.labels) == (500_003, 1, 500_000, "mit") and time.time() - start < 60


def test_license_query_takes_the_phrases_of_its_contract(spark, tmp_path):
    texts = ["Released under the MIT License.", "the MIT license", "under the mit, under the mit license cc by nc", "mit license under the", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in QUERIES["op10_licenses"](spark, str(tmp_path)).collect()}
    base = {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in rows.items()}
    assert base == {0: (5, 1, 1, 1, "mit"), 1: (3, 0, None, None, ""), 2: (10, 2, 3, 7, "cc-by-nc,mit"), 3: (4, 0, None, None, ""),
                    4: (0, 0, None, None, "")}
    # A licence that is only named keeps its label, by the method.
    assert (rows[1].labels, rows[1].score, rows[3].labels) == ("mit", 1.0, "")


def test_bpe_remembers_frequent_words(monkeypatch):
    """A frequent word is encoded once, however many others come between; plain pieces are those of the property classes."""
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    encoder = bpe.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    made, plain_word = [], encoder.word
    encoder.seen.make = lambda piece: (made.append(piece), plain_word(piece))[1]
    text = " ".join(f"often w{'x' * (i % 50)}" for i in range(200))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert made.count("often") == 1 and len(encoder.seen) + len(encoder.seen.last) <= 8
    letters = [chr(c) for c in range(0x300) if bpe._PLAIN.fullmatch(chr(c))]
    for mixed in ["".join(letters), "".join(x + y for x, y in zip(letters, letters[::-1])), " 1".join(letters), "a'll b's 12\tc"]:
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        assert bpe._PIECE.findall(mixed.lower()) == bpe.regex.findall(pattern, mixed.lower())
