"""Language-model scoring with a weighted backoff automaton.

States are the word pairs seen in training, the words seen in training, the start of a text, and a root. In a pair's state (u, v),
reading w follows the arc of the triple if that was seen, with weight log10 of  s(uv) * c(uvw)/c(uv) + (1 - s(uv)) * p(w|v); otherwise the
failure arc, weight log10(1 - s(uv)), leads to the state of v, where the same is tried with the pair (v, w), and from there to the root,
where w weighs log10 p(w), p being the add-one unigram model. Every way ends in the state of the longest of (v, w), w and nothing that
was seen. s = c / (c + FRESH * c^GROWTH) is the share of a state's tokens that repeat a follower, with the number of different
followers taken to grow as a power of c (Heaps' law); the weights of every state sum to one. Texts are read from left to right, one
token of every text at a time, each carrying its state.

Neither the words nor the pairs and triples of a corpus fit one machine, so nothing is broadcast. Documents are dealt into blocks. Every
block asks for the counts of its distinct words, pairs and triples, adding its own training counts; the questions meet in buckets
of hashes, are summed there, and the totals go back to the blocks, each of which then has the part of the automaton that its
documents can reach. A block holds `BLOCK_BYTES` of text, or the square root of `GROWTH_BYTES` times the text of a larger corpus: there are as
many buckets as blocks, so that the rows exchanged grow with the text and not with its square. Words, pairs and triples are 64-bit
hashes (pairs: a bucket number and 40 bits, triples: 36), packed into byte strings; copies and common words cost one entry per block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import chunks, is_fold, learnable, mix, per_text, word_hashes

FOLDS, HELD = 7, 2
BLOCK_BYTES = 9 << 20
GROWTH_BYTES = 2 << 10         # blocks grow from 40 GB of text on: 45 MB of text at 1 TB
SEGMENT = 4096                 # tokens of a text read in one go
FRESH, GROWTH = 6.0, 0.9
_END = np.uint64(0x1234567890ABCDEF >> 1)
_START = np.uint64(0x0FEDCBA098765432 >> 1)
_PAIR_BITS, _TRIPLE_BITS = 40, 36
_MARK = {3: np.uint64((1 << 24) - 1), 4: np.uint64((1 << 32) - 1)}


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all tokens, every text closed by one end, and per text its first token (and the total)."""
    parts, sizes = [], []
    for a, b in chunks(texts):
        hashes, _, _, _, firsts = word_hashes(texts[a:b])
        ends = firsts[1:] + np.arange(b - a)
        out = np.empty(len(hashes) + b - a, np.uint64)
        word = np.ones(len(out), bool)
        word[ends] = False
        out[word], out[ends] = hashes >> np.uint64(1), _END
        parts.append(out)
        sizes.append(np.diff(firsts) + 1)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def contexts(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The state before every token: the token before it, or the start of a text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[firsts[:-1]] = _START
    return before


def _bucket(hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def triple_keys(before: np.ndarray, firsts: np.ndarray, pairs: np.ndarray, words: np.ndarray, buckets: int) -> np.ndarray:
    """Keys of the two tokens before every token and itself; the first token of a text has none but its pair."""
    context = np.empty_like(pairs)
    context[1:] = pairs[:-1]
    context[firsts[:-1]] = _START
    return pair_keys(context ^ np.uint64(0xA5A5A5A5A5A5A5A5), words, buckets, _TRIPLE_BITS)


def pair_keys(before: np.ndarray, words: np.ndarray, buckets: int, bits: int = _PAIR_BITS) -> np.ndarray:
    """Bucket and some further bits of every pair's hash."""
    h = mix(before * np.uint64(0x9E3779B97F4A7C15) + words)
    return (_bucket(h, 64, buckets) << np.uint64(bits)) | (h & np.uint64((1 << bits) - 1))


def distinct(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, how often each occurs in training tokens, and the place of every token's key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    counts = np.add.reduceat(learn[order].astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    return ordered[starts], counts, where


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and steps of three, four or eight bytes, whichever is shortest; a longer step is marked by the
    largest value and follows in full."""
    steps = np.diff(keys)
    far = {w: np.flatnonzero(steps >= _MARK[w]) for w in (3, 4)}
    width = min((3, 4, 8), key=lambda w: w * len(steps) + 8 * len(far.get(w, ())))
    if width == 8:
        body, full = steps.tobytes(), b""
    else:
        small = np.minimum(steps, _MARK[width]).astype("<u4")
        body = small.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        full = steps[far[width]].tobytes()
    return bytes([width]) + (len(full) // 8).to_bytes(4, "little") + keys[:1].tobytes() + body + full


def unpack_keys(data: bytes) -> np.ndarray:
    width, far = data[0], int.from_bytes(data[1:5], "little")
    end = len(data) - 8 * far
    raw = np.frombuffer(data, np.uint8, end - 13, 13).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    steps = steps.view("<u8").ravel()
    if far:
        steps[steps == _MARK[width]] = np.frombuffer(data, np.uint64, far, end)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 5), steps]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte per count; those from 255 on follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.int64)
    return out


class _Block:
    """Tokens of a block's documents, with the distinct words and pairs in bucket order."""

    def __init__(self, docs: pd.DataFrame, buckets: int):
        texts = [bytes(t) for t in docs["text"]]
        self.words, self.firsts = tokens(texts)
        learn = np.repeat(docs["learn"].to_numpy(bool), np.diff(self.firsts))
        before = contexts(self.words, self.firsts)
        self.word, self.word_counts, self.word_at = distinct(self.words, learn)
        pairs = pair_keys(before, self.words, buckets)
        self.pair, self.pair_counts, self.pair_at = distinct(pairs, learn)
        self.triple, self.triple_counts, self.triple_at = distinct(triple_keys(before, self.firsts, pairs, self.words, buckets), learn)
        of = {"word": _bucket(self.word, 63, buckets).astype(np.int64), "pair": (self.pair >> np.uint64(_PAIR_BITS)).astype(np.int64),
              "triple": (self.triple >> np.uint64(_TRIPLE_BITS)).astype(np.int64)}
        self.asked = np.unique(np.concatenate([np.unique(b) for b in of.values()]))
        self.cuts = {what: [*np.searchsorted(b, self.asked), len(b)] for what, b in of.items()}


KINDS = ("word", "pair", "triple")


def _questions(buckets: int):
    def ask(docs: pd.DataFrame) -> pd.DataFrame:
        block, rows = _Block(docs, buckets), []
        for i, bucket in enumerate(block.asked):
            row = {"bucket": int(bucket), "block": int(docs["block"].iloc[0])}
            for what in KINDS:
                part = slice(*block.cuts[what][i:i + 2])
                row[f"n_{what}"] = part.stop - part.start
                row[f"{what}_keys"] = pack_keys(getattr(block, what)[part])
                row[f"{what}_counts"] = pack_counts(getattr(block, f"{what}_counts")[part])
            rows.append(row)
        return pd.DataFrame(rows, columns=["bucket", "block", *[f"{x}{what}{y}" for what in KINDS for x, y in (("n_", ""), ("", "_keys"), ("", "_counts"))]])

    return ask


def _totals(asked: pd.DataFrame) -> pd.DataFrame:
    """Answers to every block's questions of a bucket: the training counts of its words, pairs and triples over all blocks."""
    out = {"block": asked["block"], "bucket": asked["bucket"]}
    for what in KINDS:
        n = asked[f"n_{what}"].to_numpy()
        keys = np.concatenate([unpack_keys(bytes(k)) if m else np.empty(0, np.uint64) for k, m in zip(asked[f"{what}_keys"], n)])
        counts = np.concatenate([unpack_counts(bytes(c), m) for c, m in zip(asked[f"{what}_counts"], n)])
        _, _, where = distinct(keys, np.zeros(len(keys), bool))
        total = np.bincount(where, counts).astype(np.int64)[where] if len(keys) else counts
        out[f"n_{what}"] = asked[f"n_{what}"]
        out[f"{what}_totals"] = [pack_counts(c) for c in np.split(total, np.cumsum(n)[:-1])]
    return pd.DataFrame(out)


def _repeats(count: np.ndarray) -> np.ndarray:
    """s(v): 0 for a state that training never saw."""
    c = np.maximum(count, 1).astype(float)
    return np.where(count > 0, c / (c + FRESH * c ** GROWTH), 0.0)


class Automaton:
    """The states and arcs that the tokens of a block can reach.

    States are numbers: the words of the block, then the start of a text, the root, and the block's pairs. `fails_to` and `failure` hold every
    state's failure arc. A word state has an arc for every pair (word, next) that was seen, a pair state for every triple, the
    root for every word.
    """

    def __init__(self, block: _Block, totals: dict[str, np.ndarray], texts: int, log_all: float):
        self.block, self.totals = block, totals
        words, pairs = totals["word"], totals["pair"]
        n = len(words)
        self.start, self.root, self.pairs = n, n + 1, n + 2
        at, place = block.word_at, np.arange(len(block.words))
        is_first = np.zeros(len(place), bool)
        is_first[block.firsts[:-1]] = True
        # One token of every pair and triple tells the states it leads from and to.
        example = np.empty(len(block.pair), np.int64)
        example[block.pair_at] = place
        before = np.where(is_first[example], self.start, at[example - 1])
        states = np.concatenate([words, [texts, 0], pairs])
        share = _repeats(states)
        self.failure = np.log10(1 - share)
        self.fails_to = np.full(len(states), self.root)
        self.fails_to[self.pairs:] = np.where(words[at[example]] > 0, at[example], self.root)
        self.at_root = np.log10(words + 1.0) - log_all
        p_pair = share[before] * pairs / np.maximum(states[before], 1) + (1 - share[before]) * 10.0 ** self.at_root[at[example]]
        self.pair_arc = np.log10(p_pair)
        third = np.empty(len(block.triple), np.int64)
        third[block.triple_at] = place
        context = np.where(is_first[third], self.root, self.pairs + block.pair_at[third - 1])
        p_triple = share[context] * totals["triple"] / np.maximum(states[context], 1) + (1 - share[context]) * p_pair[block.pair_at[third]]
        self.triple_arc = np.log10(p_triple)
        self.states = states

    def state_after(self, tokens: np.ndarray) -> np.ndarray:
        """The longest seen of a token's pair, its word, and nothing."""
        word, pair = self.block.word_at[tokens], self.block.pair_at[tokens]
        return np.where(self.totals["pair"][pair] > 0, self.pairs + pair, np.where(self.totals["word"][word] > 0, word, self.root))

    def read(self, state: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step: (weight, next state) of reading `tokens` (places in the block) in `state`."""
        word, pair, triple = self.block.word_at[tokens], self.block.pair_at[tokens], self.block.triple_at[tokens]
        weight = np.zeros(len(tokens))
        on_pair = state >= self.pairs
        follows = on_pair & (self.totals["triple"][triple] > 0)
        weight[follows] = self.triple_arc[triple[follows]]
        fails = on_pair & ~follows
        weight[fails] = self.failure[state[fails]]
        here = np.where(fails, self.fails_to[state], state)
        on_word = ~follows & (here < self.root)
        follows_word = on_word & (self.totals["pair"][pair] > 0)
        weight[follows_word] += self.pair_arc[pair[follows_word]]
        fails = on_word & ~follows_word
        weight[fails] += self.failure[here[fails]]
        at_root = ~follows & ~follows_word
        weight[at_root] += self.at_root[word[at_root]]
        return weight, self.state_after(tokens)


def walk(automaton: Automaton, segment: int = SEGMENT) -> np.ndarray:
    """Log10 probability of every text of the block: all texts are read from left to right together, each carrying its state. A long
    text is read in segments; the state that a segment begins in is the one the segment before it ends in, which its last token tells."""
    firsts = automaton.block.firsts
    sizes = np.diff(firsts)
    pieces = -(-sizes // segment)
    text = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = firsts[text] + number * segment
    length = np.minimum(segment, firsts[text + 1] - begin)
    order = np.argsort(-length, kind="stable")
    text, begin, length, number = text[order], begin[order], length[order], number[order]
    state = np.where(number == 0, automaton.start, automaton.state_after(np.maximum(begin - 1, 0)))
    total = np.zeros(len(text))
    still = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")     # pieces longer than t
    for t, n in enumerate(still):
        weight, state[:n] = automaton.read(state[:n], begin[:n] + t)
        total[:n] += weight
    return np.bincount(text, total, len(sizes))


def _scores(buckets: int, train_tokens: int, train_words: int, train_texts: int):
    log_all = math.log10(train_tokens + train_words + 1)

    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = _Block(docs, buckets)
        answers = answers.sort_values("bucket")
        totals = {what: np.concatenate([np.empty(0, np.int64)] + [
            unpack_counts(bytes(c), n) for c, n in zip(answers[f"{what}_totals"], answers[f"n_{what}"])]) for what in KINDS}
        n, words = np.diff(block.firsts), totals["word"]
        return pd.DataFrame({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": n,
            "n_known": per_text((words > 0)[block.word_at].astype(float), block.firsts).round().astype(np.int64),
            "train_tokens": train_tokens,
            "base_score": per_text(np.log10(words + 1.0)[block.word_at], block.firsts) - n * log_all,
            "score": walk(Automaton(block, totals, train_texts, log_all)),
        })

    return score


def _vocabulary(docs: DataFrame) -> tuple[int, int, int]:
    """Training tokens, distinct training words (ends included), and training texts, over all rows."""
    def count(batches):
        for batch in batches:
            words, firsts = tokens([bytes(t) for t in batch["text"]])
            kinds, n = np.unique(words, return_counts=True)
            yield pd.DataFrame({"word": kinds.view(np.int64), "n": n})

    learning = docs.where("learn").select("text").mapInPandas(count, "word long, n long")
    kinds = learning.groupBy("word").agg(F.sum("n").alias("n"))
    end = F.max(F.when(F.col("word") == int(_END), F.col("n")))
    found = kinds.agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), end.alias("texts")).first()
    return found["all"] or 0, found["kinds"], found["texts"] or 0


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. A NULL text is an empty one,
    which still has its end. Rows with a NULL id are neither held out nor learnt from. Repeated rows count as often as
    they occur, and are dealt into blocks each on its own. Without training rows every word is unknown and both scores are 0."""
    rows = docs.select(
        "doc_id", is_fold(F.col("doc_id"), FOLDS, HELD).alias("held_out"), learnable(F.col("doc_id"), FOLDS, HELD).alias("learn"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / max(block_bytes, math.sqrt(GROWTH_BYTES * size))))
    train_tokens, train_words, train_texts = _vocabulary(rows)
    # By the row's place, so that rows of the same id and text are spread.
    blocked = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    questions = blocked.groupBy("block").applyInPandas(
        _questions(blocks), "bucket int, block int, " + ", ".join(f"n_{w} int, {w}_keys binary, {w}_counts binary" for w in KINDS))
    answers = questions.groupBy("bucket").applyInPandas(
        _totals, "block int, bucket int, " + ", ".join(f"n_{w} int, {w}_totals binary" for w in KINDS))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _scores(blocks, train_tokens, train_words, train_texts),
        f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
