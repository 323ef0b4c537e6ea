"""Katz backoff scores: Good-Turing discounted bigram counts over exactly normalised backoff.

The model learns and scores in one go, by requests and answers. Documents become blocks: rows
with the tokens of many documents, as numbers into a dictionary of their own. A block sends
each distinct token, and each distinct pair of tokens, once to the bucket of its hash, with the
block's own count; a bucket adds up the counts of all blocks and answers each of them with the
corpus counts of what it asked. So what is shuffled is the distinct n-grams of blocks, frequent
words and repeated texts cost a row a block, and all sizes have one path:

    P(w)     = d(c(w)) c(w) / N, and what is left over for all unseen words as one
    P(w | h) = d(c(h,w)) c(h,w) / c(h)      if the pair was seen
             = a(h) P(w)                    else; a(h) makes the sum over all w one
    P(w | h) = P(w)                         if h was never seen

A history's pairs meet in one bucket, so that a(h) is found there; those of histories above
HOT occurrences are spread over all buckets and their sums added up afterwards. Counts above
K lose a thousandth of one, so that no history is left without mass.

Null and blank texts are the end token alone. A null doc_id is never held out. Rows are
scored one by one; equal rows get equal scores. Texts longer than a block are scored in
pieces. No documents give no rows; with nothing to learn from, every token has probability 1.
Columns other than doc_id, held_out and text aren't looked at. Histories are told apart by 64 bits of hash, the
followers of one history by 48: two that share them count as one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import each, materialize, table
from leafmill.llm.decontamination import LOWER

#: Tokens of a block, keys of a bucket, and the largest count that is discounted.
BLOCK_TOKENS, BUCKET_KEYS, K = 1 << 21, 1 << 19, 5
#: Histories that occur more often, and more than N / HOT times, are spread over buckets: at most HOT of them.
HOT = 1 << 20
EPSILON = 1e-3
END = np.uint64(xxhash.xxh64_intdigest("end", seed=1))
BEGIN = np.uint64(xxhash.xxh64_intdigest("begin", seed=2))
FOLLOWER = np.uint64((1 << 48) - 1)


def pack(x: np.ndarray) -> bytes:
    """Integers as bytes in order of significance, compressed."""
    return zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.empty(0, kind)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower() if text.isascii() else text.translate(LOWER)
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


class Numbers(dict):
    """Numbers of tokens in order of appearance; 0 is the end."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        return n


BLOCK = "block long, rows array<long>, doc_ids array<{0}>, held array<boolean>, sizes array<long>, before array<long>, ids binary, keys binary, n_keys long, n_tokens long"


def make_blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, held_out, text) -> blocks; rows are numbers of documents, before is a piece's first history, -1 for the begin."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row = TaskContext.get().partitionId() << 40
        known, ids, pieces, held = Numbers(), [], [], 0

        def block() -> pa.RecordBatch:
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            keys = np.concatenate(([END], keys))
            order = np.argsort(keys)
            place = np.empty(len(keys), np.uint32)
            place[order] = np.arange(len(keys), dtype=np.uint32)
            columns = list(zip(*pieces, strict=True))
            before = [-1 if x is None else int(place[x]) for x in columns[4]]
            made = [[number], *([x] for x in columns[:4]), [before], [pack(place[np.array(ids, np.int64)])], [pack(keys[order])], [len(keys)], [len(ids)]]
            schema = pa.schema(block_fields(id_type))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, out, text in zip(*(each(batch.column(x)) for x in ("doc_id", "held_out", "text")), strict=True):
                row += 1
                tokens, at, last = words(text), 0, None
                while at <= len(tokens):
                    part = tokens[at : at + BLOCK_TOKENS - held]
                    at += len(part)
                    ids.extend(map(known.__getitem__, part))
                    n = len(part)
                    if at == len(tokens) and held + n < BLOCK_TOKENS:
                        ids.append(0)
                        n, at = n + 1, at + 1
                    pieces.append((row, doc_id, out, n, None if last is None else known[last]))
                    held += n
                    last = part[-1] if part else last
                    if held >= BLOCK_TOKENS:
                        yield block()
                        number, held = number + 1, 0
                        known, ids, pieces = Numbers(), [], []
        if pieces:
            yield block()

    return docs.mapInArrow(cut, BLOCK.format(dict(docs.dtypes)["doc_id"]))


def block_fields(id_type: pa.DataType) -> list:
    longs = pa.list_(pa.int64())
    lists = [("rows", longs), ("doc_ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("sizes", longs), ("before", longs)]
    return [("block", pa.int64()), *lists, ("ids", pa.binary()), ("keys", pa.binary()), ("n_keys", pa.int64()), ("n_tokens", pa.int64())]


class Block:
    """A block, unpacked."""

    def __init__(self, row: dict):
        self.block, self.rows, self.doc_ids = row["block"], row["rows"], row["doc_ids"]
        self.held, self.sizes = np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        self.ids, self.keys = unpack(row["ids"], np.uint32), unpack(row["keys"], np.uint64)
        self.before = np.array(row["before"], np.int64)

    def trains(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)

    def unigrams(self) -> np.ndarray:
        return np.bincount(self.ids[self.trains()], minlength=len(self.keys)).astype(np.uint64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Histories (the begin is len(keys)) and followers of the distinct pairs, the number of each token's pair, and training counts."""
        n = len(self.keys)
        full = self.sizes > 0
        tokens = np.empty(len(self.ids), np.int64)  # the history, then the pair
        tokens[1:] = self.ids[:-1]
        tokens[(np.cumsum(self.sizes) - self.sizes)[full]] = np.where(self.before < 0, n, self.before)[full]
        tokens *= n + 1
        tokens += self.ids
        codes, which = np.unique(tokens, return_inverse=True)
        counts = np.bincount(which[self.trains()], minlength=len(codes)).astype(np.uint64)
        return codes // (n + 1), codes % (n + 1), which, counts


ASK = "bucket int, hot boolean, block long, histories binary, runs binary, keys binary, counts binary, known binary"
ANSWER = "kind string, bucket int, hot boolean, block long, counts binary, backoff binary, backoff_keys binary, name long, sums array<double>"
ask_schema = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("block", pa.int64()), *((x, pa.binary()) for x in ("histories", "runs", "keys", "counts", "known"))])
answer_schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("hot", pa.bool_()), ("block", pa.int64()), *((x, pa.binary()) for x in ("counts", "backoff", "backoff_keys")), ("name", pa.int64()), ("sums", pa.list_(pa.float64()))])


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _bits(keys: int) -> int:
    return max(0, (keys // BUCKET_KEYS).bit_length())


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def slices(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Buckets in ascending order, and the stretch of each."""
    edges = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True]))) if len(buckets) else []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield int(buckets[i]), slice(int(i), int(j))


class Discounts:
    """Good-Turing discounts of the counts up to K; halves of one where the counts of counts are too odd for them."""

    def __init__(self, of_counts: np.ndarray):
        n = np.asarray(of_counts, np.float64)  # n[r - 1]: n-grams that occur r times, up to K + 1
        r = np.arange(1, K + 1)
        d = (r - 0.5) / r
        if n[: K + 1].all():
            common = (K + 1) * n[K] / n[0]
            good = ((r + 1) * n[1 : K + 1] / (r * n[:K]) - common) / (1 - common) if common != 1 else d
            d = np.where((good > 0) & (good < 1), good, d)
        #: What each count loses; the last stands for all above K.
        self.loss = np.append(r * (1 - d), EPSILON)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts, of counts of one or more."""
        return counts - self.loss[np.minimum(counts, K + 1).astype(np.int64) - 1]


def of_counts(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, ... K, K + 1."""
    return np.bincount(counts[counts <= K + 1].astype(np.int64), minlength=K + 2)[1:].astype(np.int64)


class Unigrams:
    """What is known of the whole corpus after the first round."""

    def __init__(self, total: int, distinct: int, n: list[int]):
        self.total, self.distinct = total, distinct
        self.discounts = Discounts(np.array(n))
        lost = np.append(n[:K], distinct - sum(n[:K])) @ self.discounts.loss
        self.unseen = float(lost) / total if total else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        return np.where(counts > 0, self.discounts(np.maximum(c, 1)) / max(self.total, 1), self.unseen)


def unigram_asks(blocks: DataFrame, bits: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                counts = b.unigrams()
                rows = [(bucket, False, b.block, None, None, pack(b.keys[at]), pack(counts[at]), None) for bucket, at in slices(bucket_of(b.keys, bits))]
                yield from rows_of(rows, ask_schema).to_batches()

    return blocks.mapInArrow(ask, ASK)


def unigram_answers(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    keys = [unpack(r["keys"], np.uint64) for r in rows]
    known, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(known), np.uint64)
    np.add.at(totals, which, np.concatenate([unpack(r["counts"], np.uint64) for r in rows]))
    seen = totals[totals > 0]
    out, at = [("sums", rows[0]["bucket"], False, -1, None, None, None, None, [seen.sum(), len(seen), *of_counts(seen)])], 0
    for r, k in zip(rows, keys, strict=True):
        out.append(("unigram", r["bucket"], False, r["block"], pack(totals[which[at : at + len(k)]]), None, None, None, None))
        at += len(k)
    return rows_of(out, answer_schema)


def known_counts(answers: list[dict], kind: str) -> np.ndarray:
    found = sorted((r for r in answers if r["kind"] == kind), key=lambda r: (r["hot"], r["bucket"]))
    return np.concatenate([unpack(r["counts"], np.uint64) for r in found])


def ordered_pairs(b: Block, counts: np.ndarray, hot_above: int, bits: int):
    """The distinct pairs in the order in which they are asked for."""
    h, w, which, own = b.pairs()
    keys = np.append(b.keys, BEGIN)
    hot = np.append(counts > hot_above, True)[h]
    bucket = np.where(hot, bucket_of(spread(keys[h] ^ spread(b.keys[w])), bits), bucket_of(spread(keys[h]), bits))
    order = np.lexsort((b.keys[w] & FOLLOWER, keys[h], bucket, hot))
    return h[order], w[order], own[order], hot[order], bucket[order], order, which, keys


def bigram_asks(hot_above: int, bits: int):
    def ask(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            b = Block(row)
            counts = known_counts(answers.to_pylist(), "unigram")
            h, w, own, hot, bucket, *_, keys = ordered_pairs(b, counts, hot_above, bits)
            for code, at in slices(bucket * 2 + hot):
                first = np.flatnonzero(np.concatenate(([True], h[at][1:] != h[at][:-1])))
                runs = np.diff(np.append(first, at.stop - at.start)).astype(np.uint32)
                follower = (b.keys[w[at]] & FOLLOWER).view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((code >> 1, bool(code & 1), b.block, pack(keys[h[at]][first]), pack(runs), follower.tobytes(), pack(own[at]), pack(counts[w[at]])))
        return rows_of(out, ask_schema)

    return ask


def bigram_answers(unigrams: Unigrams):
    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        runs = [unpack(r["runs"], np.uint32) for r in rows]
        histories = [unpack(r["histories"], np.uint64) for r in rows]
        h = np.concatenate([np.repeat(x, n) for x, n in zip(histories, runs, strict=True)])
        f = np.zeros((len(h), 8), np.uint8)
        f[:, :6] = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, 6)
        f = f.view(np.uint64).ravel()
        order = np.lexsort((f, h))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (f[order][1:] != f[order][:-1])))
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        totals = np.zeros(int(new.sum()), np.uint64)
        np.add.at(totals, which, np.concatenate([unpack(r["counts"], np.uint64) for r in rows]))
        first = order[new]
        share = unigrams.probability(np.concatenate([unpack(r["known"], np.uint64) for r in rows])[first])
        seen = totals > 0
        names, of = np.unique(h[first], return_inverse=True)  # for each history: its count, followers by count, and the share of those
        sums = np.zeros((len(names), K + 3))
        np.add.at(sums[:, 0], of[seen], totals[seen].astype(np.float64))
        np.add.at(sums, (of[seen], np.minimum(totals[seen], K + 1).astype(np.int64)), 1)
        np.add.at(sums[:, K + 2], of[seen], share[seen])
        hot, bucket = rows[0]["hot"], rows[0]["bucket"]
        out = [("sums", bucket, hot, -1, None, None, None, None, of_counts(totals[seen]))]
        if hot:
            out += [("history", bucket, hot, -1, None, None, None, name, x) for name, x in zip(names.view(np.int64), sums, strict=True)]
        at = 0
        for r, n in zip(rows, runs, strict=True):
            mine = slice(at, at := at + int(n.sum()))
            counts = totals[which[mine]]
            backoff = keys = None
            if not hot and (unseen := np.unique(of[which[mine]][counts == 0])).size:
                backoff, keys = zstandard.compress(sums[unseen].T.tobytes(), 1), pack(names[unseen])
            out.append(("bigram", bucket, hot, r["block"], pack(counts), backoff, keys, None, None))
        return rows_of(out, answer_schema)

    return answer


SCORES = "row long, doc_id {0}, n_tokens long, n_known long, base_score double, score double"
score_fields = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def backoff_weight(sums: np.ndarray, discounts: Discounts) -> np.ndarray:
    """a(h) of histories with these sums; 1 of those never seen."""
    seen = sums[:, 0] > 0
    left = sums[:, 1 : K + 2] @ discounts.loss / np.where(seen, sums[:, 0], 1)
    return np.where(seen, left / np.maximum(1 - sums[:, K + 2], 1e-300), 1.0)


def scores(unigrams: Unigrams, bigrams: Discounts, hot_keys: np.ndarray, hot_sums: np.ndarray, hot_above: int, bits: int):
    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, replies = [], answers.to_pylist()
        id_type = blocks.schema.field("doc_ids").type.value_type
        schema = pa.schema([("row", pa.int64()), ("doc_id", id_type), *score_fields])
        for row in blocks.to_pylist():
            b = Block(row)
            counts = known_counts(replies, "unigram")
            h, w, _, hot, _, order, which, keys = ordered_pairs(b, counts, hot_above, bits)
            pair = known_counts(replies, "bigram").astype(np.float64)
            known = [r for r in replies if r["backoff"]]
            names = np.concatenate([hot_keys, *(unpack(r["backoff_keys"], np.uint64) for r in known)])
            sums = np.concatenate([hot_sums, *(np.frombuffer(zstandard.decompress(r["backoff"])).reshape(K + 3, -1).T for r in known)])
            by_name = np.argsort(names)
            unseen = pair == 0
            weight = np.ones(len(pair))
            if unseen.any():
                at = by_name[np.searchsorted(names[by_name], keys[h[unseen]])]
                weight[unseen] = backoff_weight(sums[at], bigrams)
            history = np.append(counts, 0).astype(np.float64)[h]
            begin = h == len(b.keys)
            if begin.any():
                at = by_name[np.searchsorted(names[by_name], BEGIN)]
                history[begin] = sums[at, 0]
            seen = bigrams(np.maximum(pair, 1)) / np.maximum(history, 1)
            p = np.where(unseen, weight * unigrams.probability(counts[w]), seen)
            logs = np.empty(len(p))
            logs[order] = np.log10(p)
            tokens = logs[which]
            c = counts[b.ids].astype(np.float64)
            base = np.log10((c + 1) / (unigrams.total + unigrams.distinct + 1))
            piece = np.repeat(np.arange(len(b.sizes)), b.sizes)
            add = lambda x: np.bincount(piece, x, len(b.sizes))  # noqa: B023, E731
            made = [b.rows, b.doc_ids, b.sizes, add(c > 0).astype(np.int64), add(base), add(tokens)]
            out.append(pa.table([pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return score


def _summed(answers: DataFrame, length: int) -> np.ndarray:
    """The sums of all buckets, added up: a few numbers."""
    found = answers.filter("kind = 'sums'").agg(*[F.sum(F.col("sums")[i]) for i in range(length)]).first()
    return np.array([int(x or 0) for x in found])


def fit_and_score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents that aren't held out.
    """
    blocks = materialize(make_blocks(docs), "lm-blocks")
    size = blocks.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("keys"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    asked = unigram_asks(blocks, _bits(size["keys"]))
    first = materialize(asked.groupBy("bucket").applyInArrow(unigram_answers, ANSWER), "lm-unigrams")
    total, distinct, *n = map(int, _summed(first, K + 3))
    unigrams = Unigrams(total, distinct, n)
    hot_above, bits = max(HOT, total // HOT), _bits(size["tokens"])
    mine = first.filter("kind = 'unigram'")
    asked = blocks.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(bigram_asks(hot_above, bits), ASK)
    second = materialize(asked.groupBy("bucket", "hot").applyInArrow(bigram_answers(unigrams), ANSWER), "lm-bigrams")
    bigrams = Discounts(_summed(second, K + 1))
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(K + 3)]).alias("sums")
    hot = second.filter("kind = 'history'").groupBy("name").agg(sums).collect()  # HOT histories at most, and the begin
    hot_keys, hot_sums = np.array([r.name for r in hot], np.int64).view(np.uint64), np.array([r["sums"] for r in hot], np.float64).reshape(-1, K + 3)
    replies = mine.unionByName(second.filter("kind = 'bigram'"))
    scoring = scores(unigrams, bigrams, hot_keys, hot_sums, hot_above, bits)
    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(scoring, SCORES.format(dict(docs.dtypes)["doc_id"]))
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    scored = fit_and_score(docs.select("doc_id", out.alias("held_out"), "text"))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
