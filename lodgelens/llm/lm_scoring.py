"""Log probability of whole texts: a causal self-attention model, next to a word unigram model.

One pass over all texts stores them as ids and counts words and neighbouring subword ids of the training
texts. Their counts give the model its tables; the attention weights are fitted on every window of every
training text, by tasks in parallel whose results are averaged: each round takes the texts of its own share,
so each window is learned from once. The model then scores the stored ids of every text: overlapping
windows, each id once. A second pass over the texts gives their words' base score; the two meet by the
text's digest, whatever the order in which the rows are read.

Words of the unigram model that make up at least 1 / ``FREQUENT`` of the training text are at most that
many and are looked up in the task; counts of the others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.llm import attention_lm as lm
from lodgelens.llm.subwords import default_tokenizer, encoder
from lodgelens.llm.words import hash_strings, mix, release_memory, slices, split_words
from lodgelens.session import materialise

#: Bound of the broadcast word table: a word in it is at least this part of all training tokens.
FREQUENT = 1 << 21
#: Windows that one task fits on, its least steps (short corpora are gone through again), rounds and rate.
WINDOWS_PER_TASK, LEAST_STEPS, ROUNDS, RATE = 100_000, 60, 2, 0.02
HELD_OUT = (10, 0)
SMOOTHING = 0.1
_END = np.uint64(0x0E4D0F7E97)
_WORD, _PAIR, _IDS, _DOC, _RARE, _HELD = range(6)


def id_remainder(modulus: int):
    """crc32 of the id's text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def _rows(kind, key: np.ndarray, n: np.ndarray, data=None, digest=None) -> pa.RecordBatch:
    data = pa.nulls(len(key), pa.binary()) if data is None else pa.array(data, pa.binary())
    digest = pa.nulls(len(key), pa.binary()) if digest is None else digest
    kinds = np.broadcast_to(np.asarray(kind, np.int32), len(key))
    return pa.record_batch(
        [pa.array(kinds), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64)), data, digest],
        names=["kind", "key", "n", "data", "digest"],
    )


class _Sums:
    """Counts by key, merged when enough have gathered; sent on when the merged ones are many."""

    def __init__(self, kind: int, limit: int = 600_000):
        self.kind, self.limit, self.size = kind, limit, 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > self.limit:
            self._merge()
            if self.size > self.limit // 2:
                yield from self.flush()

    def _merge(self) -> None:
        if len(self.held) > 1:
            keys, place = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([c for _, c in self.held])).astype(np.int64)
            self.held, self.size = [(keys, counts)], len(keys)

    def flush(self):
        self._merge()
        for keys, counts in self.held:
            for i in range(0, len(keys), 100_000):
                yield _rows(self.kind, keys[i : i + 100_000].view(np.int64), counts[i : i + 100_000])
        self.held, self.size = [], 0


def _kind(size: int) -> str:
    """How ids up to ``size`` are stored."""
    return "<u2" if size < 65536 else "<u4"


def _digest():
    """A digest of the text by which its two scores meet; a null text is empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a slice, the place of every word among them and its document's number."""
    words, doc = split_words(texts)
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), doc


def _gathered(docs: DataFrame, path: str, held_out: Column | None = None) -> DataFrame:
    """Each text as ids with its windows' number; counts of words and of pairs of ids of the training texts.

    All texts are training texts unless ``held_out`` tells which are not. The key of a text's ids is a hash of its doc_id and its ids, which deals it to a round.
    """

    def run(batches):
        words_seen, pairs_seen = _Sums(_WORD), _Sums(_PAIR)
        for part in slices(batches):
            code = encoder(path)
            edge = code.vocabulary
            learned = ~part["held_out"].to_numpy(zero_copy_only=False)
            names, place, doc = _words(part["text"])
            counts = np.bincount(place[learned[doc]], minlength=len(names))
            seen = np.flatnonzero(counts)
            keys, counts = hash_strings(names)[seen], counts[seen]
            if learned.any():
                yield from words_seen.add(np.append(keys, _END), np.append(counts, learned.sum()))
            ids, per_word = code.gather(code.rows(names)[place]) if len(place) else (np.empty(0, np.uint32), np.empty(0))
            per_doc = np.bincount(doc, weights=per_word, minlength=len(part)).astype(np.int64)
            y = np.insert(ids.astype(np.int64), np.cumsum(per_doc), edge)
            x = np.concatenate([[edge], y[:-1]])
            own = np.repeat(learned, per_doc + 1)
            pairs, times = np.unique((x * (edge + 1) + y)[own], return_counts=True)
            yield from pairs_seen.add(pairs.astype(np.uint64), times)
            ends = np.cumsum(per_doc)
            packed = ids.astype(_kind(edge))
            rid = part["doc_id"].cast(pa.int64()).fill_null(-1).to_numpy().view(np.uint64)
            held = [packed[stop - n : stop].tobytes() for n, stop in zip(per_doc.tolist(), ends.tolist(), strict=True)]
            key = mix(rid * np.uint64(0x9E3779B97F4A7C15) + per_doc.astype(np.uint64))
            yield _rows(np.where(learned, _IDS, _HELD), key.view(np.int64), lm.windows_of(per_doc), held, part["digest"])
        yield from words_seen.flush()
        yield from pairs_seen.flush()

    is_held = F.lit(False) if held_out is None else held_out
    rows = docs.select("doc_id", "text", is_held.alias("held_out"), _digest().alias("digest"))
    return rows.mapInArrow(run, "kind int, key long, n long, data binary, digest binary")


def _fit(gathered: DataFrame, size: int) -> lm.Model:
    """The model from the counts of pairs of ids and all training texts' ids."""
    spark = gathered.sparkSession
    base = size + 1
    pairs = gathered.where(F.col("kind") == _PAIR).groupBy("key").agg(F.sum("n").alias("n"))
    pairs = materialise(pairs.select((F.col("key") / base).cast("long").alias("a"), (F.col("key") % base).alias("b"), "n"), "pairs")
    counts = np.zeros(base)
    for b, n in _columns(pairs.groupBy("b").agg(F.sum("n").alias("n")), "b", "n"):  # at most one row per id
        counts[b] = n
    vocabulary = lm.Vocabulary(size, counts)

    def summed(row_of: np.ndarray, column_of: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Sums of the pairs by row of the first and column of the second id: a table of fixed size."""
        wide = shape[1]

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    key = row_of[batch["a"].to_numpy()] * wide + column_of[batch["b"].to_numpy()]
                    names, place = np.unique(key, return_inverse=True)
                    total = np.bincount(place, weights=batch["n"].to_numpy())
                    yield pa.record_batch([pa.array(names.astype(np.int64)), pa.array(total.astype(np.int64))], names=["key", "n"])

        out = np.zeros(shape[0] * shape[1])
        for key, n in _columns(pairs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "key", "n"):
            out[key] = n
        return out.reshape(shape)

    after = summed(vocabulary.context, vocabulary.column, (vocabulary.contexts, len(vocabulary.seen) + 1))[:, :-1]
    vocabulary.set_classes(after)
    by_row = summed(vocabulary.row, vocabulary.kind, (vocabulary.rows, lm.CLASSES))
    model = lm.Model(vocabulary, *lm.tables(vocabulary, by_row, after), lm.initial(vocabulary.rows))
    texts = gathered.where(F.col("kind") == _IDS).select((F.pmod("key", F.lit(ROUNDS))).alias("turn"), "n", "data")
    shares = dict(texts.groupBy("turn").agg(F.sum("n").alias("n")).collect())  # at most ROUNDS rows
    kind = _kind(size)
    for turn in range(ROUNDS):
        if turn not in shares:
            continue
        tasks = -(-shares[turn] // WINDOWS_PER_TASK)
        held = spark.sparkContext.broadcast(lm.Model(vocabulary, model.step, None, model.weights))

        def train(batches, held=held, turn=turn):
            _without_encoder()
            ids = [np.frombuffer(v.as_buffer(), kind) for b in batches for v in b["data"]]
            if ids:
                per_doc = np.array([len(v) for v in ids])
                x, y, scored, _ = lm.cut_windows(np.concatenate(ids), per_doc, size)
                ids.clear()
                release_memory()
                weights = held.value.train(x, y, scored, LEAST_STEPS, RATE / (1 + turn), turn)
                yield pa.record_batch(
                    [pa.array(np.arange(len(weights))), pa.array(weights.astype(np.float64) * len(x)), pa.array(np.full(len(weights), float(len(x))))],
                    names=["at", "w", "m"],
                )
            release_memory()

        own = texts.where(F.col("turn") == turn).select("data")
        parts = own.repartition(tasks).mapInArrow(train, "at long, w double, m double")
        mean = parts.groupBy("at").agg((F.sum("w") / F.sum("m")).alias("w"))
        weights = model.weights.copy()
        for at, w in _columns(mean, "at", "w"):  # one row per weight
            weights[at] = w
        held.destroy()  # its rows are here
        model = lm.Model(vocabulary, model.step, model.within, weights)
    return model


def _without_encoder() -> None:
    """Drop the worker's encoder and its stored words: stored ids are read without it."""
    encoder.cache_clear()
    release_memory()


def _columns(rows: DataFrame, *names: str):
    """The only batch of a bounded result as arrays."""
    table = rows.select(*names).toArrow()
    return [tuple(table[n].to_numpy() for n in names)]


def score_texts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Learned from the rows whose id has not the held-out remainder. Tokens are lower-cased words and one
    end per text; ``base_score`` is their smoothed unigram log10 probability, ``score`` the attention
    model's for the text's subword ids and end. A null text is empty: its end is its only token.
    Repeated rows count and are scored as often as they occur; a null id counts as an empty text in the
    remainder. Without training rows both models are uniform. Other columns are ignored. The models are
    fitted when this is called.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    held_out = id_remainder(HELD_OUT[0]) == HELD_OUT[1]
    gathered = materialise(_gathered(docs, path, held_out), "gathered", "zstd")
    words = gathered.where(F.col("kind") == _WORD).groupBy("key").agg(F.sum("n").alias("c"))
    words = materialise(words, "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    whole, below = total["n"], total["n"] + SMOOTHING * (total["v"] + 1)
    size = encoder(path).vocabulary
    scores = materialise(_model_scores(gathered, _fit(gathered, size), size), "scores")
    [(key, count)] = _columns(words.where(F.col("c") * FREQUENT >= whole), "key", "c")  # at most FREQUENT rows
    order = np.argsort(key.view(np.uint64))
    held = spark.sparkContext.broadcast((key.view(np.uint64)[order], count[order].astype(np.int64)))

    def run(batches):
        from pyspark import TaskContext

        keys, counts = held.value
        worth = np.log10((counts + SMOOTHING) / below)
        rid = TaskContext.get().partitionId() << 40
        for part in slices(batches):
            size = len(part)
            names, place, doc = _words(part["text"])
            names = np.append(hash_strings(names), _END)
            place = np.concatenate([place, np.full(size, len(names) - 1)])
            doc_of = np.concatenate([doc, np.arange(size)])
            at = np.minimum(np.searchsorted(keys, names), max(len(keys) - 1, 0))
            frequent = keys[at] == names if len(keys) else np.zeros(len(names), bool)
            value = np.where(frequent, worth[at] if len(keys) else 0.0, 0.0)
            base = np.bincount(doc_of, weights=value[place], minlength=size)
            known = np.bincount(doc_of, weights=frequent[place], minlength=size).astype(np.int64)
            yield pa.record_batch(
                [
                    pa.array(np.full(size, _DOC, np.int32)),
                    pa.array(rid + np.arange(size)),
                    part["doc_id"].cast(pa.int64()),
                    part["held_out"],
                    pa.array(np.bincount(doc_of, minlength=size).astype(np.int64)),
                    pa.array(known),
                    pa.array(base),
                    pa.nulls(size, pa.int64()),
                    part["digest"],
                ],
                names=_SCORED,
            )
            rare = np.flatnonzero(~frequent[place])
            pairs, times = np.unique(doc_of[rare] * len(names) + place[rare], return_counts=True)
            d, h = pairs // len(names), names[pairs % len(names)]
            for i in range(0, len(pairs), 100_000):
                to = slice(i, i + 100_000)
                own = len(pairs[to])
                blank = pa.nulls(own, pa.int64())
                yield pa.record_batch(
                    [
                        pa.array(np.full(own, _RARE, np.int32)),
                        pa.array(rid + d[to]),
                        blank,
                        pa.nulls(own, pa.bool_()),
                        pa.array(times[to].astype(np.int64)),
                        blank,
                        pa.nulls(own, pa.float64()),
                        pa.array(h[to].view(np.int64)),
                        pa.nulls(own, pa.binary()),
                    ],
                    names=_SCORED,
                )
            rid += size

    rows = docs.select("doc_id", "text", held_out.alias("held_out"), _digest().alias("digest"))
    scored = materialise(rows.mapInArrow(run, _SCORED_SCHEMA), "scored", "zstd")
    rare = scored.where(F.col("kind") == _RARE).select("rid", F.col("key"), F.col("n_tokens").alias("n"))
    counted = rare.join(words, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    worth = F.log10((F.col("c") + SMOOTHING) / F.lit(float(below)))
    more = counted.groupBy("rid").agg(F.sum(F.col("n") * worth).alias("_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"))
    return (
        scored.where(F.col("kind") == _DOC)
        .join(more, "rid", "left")
        .join(scores.groupBy("digest").agg(F.max("score").alias("score")), "digest", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(whole).cast("long").alias("train_tokens"),
            (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
            "score",
        )
    )


def _model_scores(gathered: DataFrame, model: lm.Model, size: int) -> DataFrame:
    """digest, score: the model's log10 probability of each stored text; copies have equal rows."""
    held = gathered.sparkSession.sparkContext.broadcast(model)
    kind = _kind(size)

    def run(batches):
        _without_encoder()
        model = held.value
        for part in slices(batches, "data"):
            ids = np.frombuffer(b"".join(part["data"].to_pylist()), kind)
            per_doc = pc.binary_length(part["data"]).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
            score = np.zeros(len(part))
            for x, y, scored, owner in lm.window_blocks(ids, per_doc, size, lm.CUT):
                for pick, start in lm.parts(scored):
                    found = model.log_probability(x[pick], y[pick], start) * scored[pick, start:]
                    score += np.bincount(owner[pick], weights=found.sum(axis=1, dtype=np.float64), minlength=len(part))
            yield pa.record_batch([part["digest"], pa.array(score / np.log(10))], names=["digest", "score"])

    texts = gathered.where(F.col("kind").isin(_IDS, _HELD)).select("data", "digest")
    return texts.mapInArrow(run, "digest binary, score double")


_SCORED = ["kind", "rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "key", "digest"]
_SCORED_SCHEMA = (
    "kind int, rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, key long, digest binary"
)
