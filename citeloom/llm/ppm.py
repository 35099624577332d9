"""Language-model scores by prediction by partial matching (PPM) over bytes.

Text: its words (runs of bytes that are not ASCII white space, A-Z lower-cased), each coded byte by byte and closed by one space, then an end
symbol: a second space. A symbol's contexts are the last ORDER, ORDER - 1, ..., 0 bytes of the text, across words; before a text
stand spaces. The trie holds for each context how often each symbol followed it in the training documents. A symbol is sought from the
longest context down; each step down costs the escape probability, and symbols that a longer context holds are excluded from the
shorter one (they would have been coded there). Below the empty context all remaining symbols are alike. With counts n a
symbol weighs 2n - 1 and the escape weighs the number of distinct symbols (method D).

There is one trie for each frequent value of a class column (languages) and one for the rest; a text's probability is
the mixture over classes, so it depends on the text alone. Inside a document the model adapts: a token's probability mixes the
pretrained one, given all that stands before it, with weight ``strength``, and the document's tokens so far. Both keep it a
probability over texts.

A symbol and its longest context are a gram of ORDER + 1 bytes, and its code length depends on the gram alone. So the distinct grams
of a block of documents are counted, scored once, and go back to the block. Most recent byte first, sorted grams stand by
context at every order. The contexts of up to LOW bytes are broadcast: they are bounded by the bytes there are, not by the corpus.
Nothing that grows with the corpus is broadcast or reaches the driver:

1. one pass over the documents writes their words in order as local numbers, per block of documents the block's
   distinct words with their training counts, and its distinct grams with theirs, dealt to buckets by their last LOW + 1 bytes of context;
2. word counts are summed by word, for the base score; gram counts of the short contexts are summed;
3. each group of buckets holds all nodes of its longer contexts, and scores the grams of all blocks;
4. word counts and gram scores go back to the document blocks, which are read again in order.

Defined results: null text counts as empty: one token, the end. Null ids belong to the training part. Null classes belong to the rest.
Without any training document all counts are nought and every symbol is one of 256 alike. Repeated rows count, and are scored, as
often as they occur. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import Scratch

#: Longest context in bytes, so that a gram fits one long with its class, and the longest that is broadcast.
ORDER, LOW = 5, 2
SPACE, ALPHABET = 32, 256
#: Bytes of text per block of documents, words of vocabulary per group of buckets, the fewest buckets, groups for each block, and symbols taken at once.
BLOCK_BYTES, BLOCK_WORDS, BUCKETS, BLOCK_GROUPS, CHUNK = 32 << 20, 50_000, 256, 4, 1 << 18
#: The class number of documents that are not trained on.
OUT = 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coded symbols of words in turn, the index of each symbol's word, and its place in the word.

    The empty word stands for the end of a document; what follows is another document.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sizes = lengths + 1
    out = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    ends = np.cumsum(sizes) - 1
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(out)) - np.repeat(ends - lengths, sizes)
    return out, word, place


def grams(found: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each symbol with the ORDER bytes before it, the last one on top, the symbol lowest."""
    starts = np.flatnonzero(np.concatenate(([True], (found[:-1] == SPACE) & (place[:-1] == 0))))
    lengths = np.diff(starts, append=len(found))
    out = found.copy()
    for k in range(1, ORDER + 1):
        shift = 8 * (ORDER + 1 - k)
        out[k:] |= found[:-k] << shift
        # what lies before the document
        for j in range(k):
            at = starts[lengths > j] + j
            out[at] = (out[at] & ~(255 << shift)) | (SPACE << shift)
    return out


def levels(gram: np.ndarray) -> list[np.ndarray]:
    """Per order, each gram's context as a number: the bytes themselves, with their number on top."""
    context = gram >> 8
    return [(context >> (8 * (ORDER - k))) | (k << 40) for k in range(ORDER + 1)]


def context_keys(found: np.ndarray, word: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Per order, each coded symbol's context."""
    return levels(grams(found, place))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's numbers. Keys that come in sorted runs are merged."""
    if not len(keys):
        return keys, n
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], np.add.reduceat(n, start)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers, compressed with like bytes side by side."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def spread(held: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(held), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _packed(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=0))


def _unpacked(held: bytes) -> np.ndarray:
    return np.cumsum(spread(held, np.int64))


def edges(found: np.ndarray, keys: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, suffix, symbol, count) of the trie that these coded symbols make, sorted by context and symbol; the empty context's suffix is -1.

    Each order is counted from the entries of the order above, which are fewer than the symbols.
    """
    at = weight > 0
    both, n = (keys[-1][at] << 9) | found[at], weight[at].astype(np.int64)
    held = []
    for level in range(len(keys) - 1, -1, -1):
        both, n = summed(both, n)
        context, symbol = both >> 9, both & 511
        # the oldest byte stands lowest and goes
        suffix = ((context & ((1 << 40) - 1)) >> 8) | ((level - 1) << 40) if level else np.full(len(both), -1)
        held.append((context, suffix, symbol, n))
        both = (suffix << 9) | symbol
    return tuple(np.concatenate(h) for h in zip(*reversed(held)))


class Trie:
    """The nodes that a block of words needs, with all of their suffixes."""

    def __init__(self, context: np.ndarray, suffix: np.ndarray, symbol: np.ndarray, count: np.ndarray):
        """The entries come sorted by context and symbol, as ``edges`` gives them."""
        first = np.concatenate(([True], context[1:] != context[:-1])) if len(context) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        self.nodes = context[start]
        node = np.cumsum(first) - 1
        self.edge = node * 512 + symbol
        self.weight = 2.0 * count - 1
        self.total = np.add.reduceat(self.weight, start) if len(start) else np.array([])
        self.distinct = np.bincount(node, minlength=len(self.nodes)).astype(float)
        # per node, the weight that its symbols have in its suffix: what is excluded there
        held = self.find_edge(self.find(suffix), symbol)
        self.excluded = np.bincount(node, np.where(held >= 0, self.weight[np.maximum(held, 0)] if len(self.weight) else 0, 0), len(self.nodes))

    def find(self, context: np.ndarray) -> np.ndarray:
        if not len(self.nodes):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.nodes, context), len(self.nodes) - 1)
        return np.where(self.nodes[at] == context, at, -1)

    def find_edge(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not len(self.edge):
            return np.full(len(node), -1)
        key = node * 512 + symbol
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where((node >= 0) & (self.edge[at] == key), at, -1)

    def score(self, found: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each coded symbol after its context."""
        n = len(found)
        logp, mass, seen = np.zeros(n), np.zeros(n), np.zeros(n)
        left = np.arange(n)
        for key in reversed(keys):
            node = self.find(key[left])
            known = np.flatnonzero(node >= 0)
            i, at = left[known], node[known]
            rest, fresh = self.total[at] - mass[i], self.distinct[at] - seen[i]
            edge = self.find_edge(at, found[i])
            hit = edge >= 0
            logp[i[hit]] += np.log10(self.weight[edge[hit]] / (rest + fresh)[hit])
            miss = ~hit & (fresh > 0)
            logp[i[miss]] += np.log10(fresh[miss] / (rest + fresh)[miss])
            mass[i], seen[i] = self.excluded[at], self.distinct[at]
            left = np.delete(left, known[hit])
        logp[left] -= np.log10(np.maximum(1.0, ALPHABET - seen[left]))
        return logp


#: Scores travel as whole steps below nought.
STEP = float(1 << 16)


def stepped(log_p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-log_p * STEP), (1 << 31) - 1).astype(np.int32)


def mixture(log_p: np.ndarray, tokens: np.ndarray, starts: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """log10 of the mixture over classes of each adaptive document's probability. ``log_p`` has a row per token, in order; a document's
    tokens begin at its start."""
    n = len(tokens)
    lengths = np.diff(starts, append=n)
    document = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(n) - np.repeat(starts, lengths)
    # how often the document has held the token before
    both = document * (int(tokens.max(initial=0)) + 1) + tokens
    order = np.argsort(both, kind="stable")
    held, place = both[order], np.arange(n)
    before = np.empty(n)
    before[order] = place - np.maximum.accumulate(np.where(np.concatenate(([True], held[1:] != held[:-1])), place, 0))
    each = log_p + np.log10(strength)
    again = before > 0
    each[again] = np.log10(strength * 10.0 ** np.maximum(log_p[again], -300) + before[again, None])
    whole = np.add.reduceat(each, starts, axis=0) - np.add.reduceat(np.log10(strength + at), starts)[:, None] + prior
    top = whole.max(axis=1)
    return top + np.log10((10.0 ** (whole - top[:, None])).sum(axis=1))


def _bags(docs: DataFrame, classes: int, buckets: int) -> DataFrame:
    """Step 1. kind 0: doc_id, block, n_tokens, tokens. kind 1: block, number, word, training count; ends by class for the empty word. kind 2: block, bucket, grams, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # what a reused worker has kept from the large tables of another stage
        pa.default_memory_pool().release_unused()
        part, block, size = TaskContext.get().partitionId() << 24, 0, 0
        number: dict[bytes, int] = {}
        trained = np.zeros(0, np.int64)
        ends = [0] * classes
        waiting: list[bytes] = []
        codes: list[int] = []
        sizes: list[int] = []
        learned: list[np.ndarray] = []
        open_bytes = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            """Counts the grams of the waiting words, and the words to learn from."""
            nonlocal open_bytes, trained
            if learned:
                more = np.bincount(np.concatenate(learned), minlength=len(trained))
                more[: len(trained)] += trained
                trained = more
                learned.clear()
            if waiting:
                found, _, place = symbols(waiting)
                gram = grams(found, place)
                held.append(np.unique((gram << 4) | np.repeat(np.repeat(np.array(codes, np.int64), sizes), np.diff(np.flatnonzero(place == 0), append=len(place))), return_counts=True))
                if sum(len(k) for k, _ in held) > 8 * CHUNK:
                    held[:] = [summed(*map(np.concatenate, zip(*held)))]
            waiting.clear()
            codes.clear()
            sizes.clear()
            open_bytes = 0

        def numbers(words: list[bytes]) -> np.ndarray:
            for w in set(words).difference(number):
                number[w] = len(number)
            return np.fromiter(map(number.__getitem__, words), np.int32, len(words))

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal block, size, trained
            fold()
            trained = np.pad(trained, (0, len(number) - len(trained)))
            words = list(number)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                counts = pa.array(trained[at : at + 50_000])
                last = pa.array([None if w else list(ends) for w in some], pa.list_(pa.int64()))
                yield _rows(len(some), kind=1, block=part + block, number=pa.array(range(at, at + len(some)), pa.int32()), word=pa.array(some, pa.binary()), count=counts, ends=last)
            if held:
                keys, n = summed(*map(np.concatenate, zip(*held)))
                bucket = (((keys >> (4 + 8 * (ORDER - LOW))).astype(np.uint64) * _MIX) >> np.uint64(40)).astype(np.int64) * buckets >> 24
                order = np.argsort(bucket, kind="stable")
                keys, n, bucket = keys[order], n[order], bucket[order]
                names, start = np.unique(bucket, return_index=True)
                edge = [*start.tolist(), len(keys)]
                blobs = [(_packed(keys[i:j]), squeezed(n[i:j].astype(np.int32))) for i, j in zip(edge, edge[1:])]
                yield _rows(len(names), kind=2, block=part + block, bucket=pa.array(names.astype(np.int32)), grams=pa.array([b[0] for b in blobs], pa.binary()), n=pa.array([b[1] for b in blobs], pa.binary()))
            number.clear()
            held.clear()
            trained = np.zeros(0, np.int64)
            ends[:] = [0] * classes
            block, size = block + 1, 0

        for batch in batches:
            ids, totals, orders, blocks = [], [], [], []
            for doc, text, train, cls in zip(*(batch.column(i) for i in range(4))):
                content = text.as_py() or ""
                words = content.encode().lower().split()
                words.append(b"")
                order = numbers(words)
                if train.as_py():
                    learned.append(order)
                    ends[cls.as_py()] += 1
                waiting += words
                codes.append(cls.as_py() if train.as_py() else OUT)
                sizes.append(len(words))
                orders.append(squeezed(order))
                ids.append(doc.as_py())
                totals.append(len(words))
                blocks.append(part + block)
                size += len(content)
                open_bytes += len(content)
                if open_bytes > CHUNK:
                    fold()
                if size > BLOCK_BYTES:
                    yield from out()
            yield _rows(
                len(ids), kind=0, block=pa.array(blocks, pa.int64()), doc_id=pa.array(ids, pa.int64()), n_tokens=pa.array(totals, pa.int64()), tokens=pa.array(orders, pa.binary())
            )
        yield from out()

    types = {
        "kind": pa.int32(), "block": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "tokens": pa.binary(), "number": pa.int32(), "word": pa.binary(), "count": pa.int64(), "ends": pa.list_(pa.int64()),
        "bucket": pa.int32(), "grams": pa.binary(), "n": pa.binary(),
    }
    _rows = _row_maker(types)
    return docs.mapInArrow(run, "kind int, block bigint, doc_id bigint, n_tokens bigint, tokens binary, number int, word binary, count bigint, ends array<bigint>, bucket int, grams binary, n binary")


def _row_maker(types: dict[str, pa.DataType]):
    """Record batches of one wide schema; columns left out are null, numbers are repeated."""

    def make(rows: int, /, **columns) -> pa.RecordBatch:
        out = []
        for name, kind in types.items():
            value = columns.get(name)
            if value is None:
                out.append(pa.nulls(rows, kind))
            elif isinstance(value, int):
                out.append(pa.array(np.full(rows, value), kind))
            else:
                out.append(value)
        return pa.RecordBatch.from_arrays(out, list(types))

    return make


def _short_contexts(counted: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """Step 2. Per class the trie's entries of up to LOW bytes of context: at most 2^24 grams of three bytes, in texts some ten thousands."""
    cut = 4 + 8 * (ORDER - LOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for held, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = _unpacked(held)
                key, count = key[(key & 15) != OUT], spread(counts, np.int32)[(key & 15) != OUT]
                # last LOW bytes, symbol, class
                short = ((key >> (cut + 8)) << 12) | (key & 0xFFF)
                keys, n = summed(np.concatenate((keys, short)), np.concatenate((n, count)))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    found = counted.select("grams", "n").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    out = []
    for cls in range(OUT):
        mine = (key & 15) == cls
        gram = ((key[mine] >> 12) << (8 * (ORDER + 1 - LOW))) | ((key[mine] >> 4) & 255)
        out.append(edges(gram & 255, levels(gram)[: LOW + 1], n[mine]))
    return out


def _score_grams(counted: DataFrame, short, classes: int, groups: int, buckets: int) -> DataFrame:
    """Step 3. block, grams, log_p of each symbol after its context, by class. ``short``: a broadcast of the short contexts."""

    def run(table: pa.Table) -> pa.Table:
        held = [_unpacked(g) for g in table.column("grams").to_pylist()]
        n = np.concatenate([spread(c, np.int32) for c in table.column("n").to_pylist()]).astype(np.int64)
        key = np.concatenate(held)
        gram, code = key >> 4, key & 15
        every = np.unique(gram)
        needed = np.unique(np.concatenate(levels(every)[: LOW + 1]))
        log_p = np.zeros((len(every), classes), np.int32)
        for cls in range(classes):
            mine, count = summed(gram[code == cls], n[code == cls])
            long = edges(mine & 255, levels(mine), count)
            longer = long[0] >> 40 > LOW
            low = short.value[cls]
            wanted = np.isin(low[0], needed)
            trie = Trie(*(np.concatenate((b[wanted], a[longer])) for a, b in zip(long, low)))
            for at in range(0, len(every), 400_000):
                some = every[at : at + 400_000]
                log_p[at : at + 400_000, cls] = stepped(trie.score(some & 255, levels(some)))
        mine = [np.unique(k >> 4) for k in held]
        return pa.table(
            {
                "block": table.column("block"),
                "grams": pa.array([_packed(g) for g in mine], pa.binary()),
                "log_p": pa.array([squeezed(log_p[np.searchsorted(every, g)].T.copy()) for g in mine], pa.binary()),
            }
        )

    dealt = counted.select("block", "grams", "n", F.floor(F.col("bucket") * groups / buckets).cast("int").alias("group"))
    return dealt.groupBy("group").applyInArrow(run, "block bigint, grams binary, log_p binary")


class Scores:
    """The scores of a block's grams, found by hash; the few that share a slot are sought by halving."""

    def __init__(self, keys: np.ndarray, log_p: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.log_p = keys[order], log_p[order]
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(gram)]
        other = np.flatnonzero(self.keys[at] != gram)
        at[other] = np.searchsorted(self.keys, gram[other])
        return self.log_p[at]


def score_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", most_classes: int = 5, train: F.Column | None = None, strength: float = 1000.0
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``train`` tells the training rows (all, if None). ``most_classes`` values of ``class_col`` have a trie of their own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    trains = F.lit(True) if train is None else train
    cls, classes = F.lit(0), 1
    if class_col and class_col in docs.columns:
        top = docs.where(trains).groupBy(class_col).count().orderBy(F.col(class_col).isNull(), F.desc("count"), class_col).limit(most_classes + 1)
        found = [r[0] for r in top.collect()]  # at most most_classes + 1 rows
        named = [v for v in found if v is not None][:most_classes]
        # the rest has a trie where training rows belong to it
        classes = max(1, len(named) + (len(found) > len(named)))
        for i, value in enumerate(named):
            cls = F.when(F.col(class_col) == value, i).otherwise(F.lit(classes - 1) if i == 0 else cls)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), trains.alias("train"), cls.cast("int").alias("cls"))
    # buckets and groups grow with the text, so that what meets in one task does not
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    buckets = max(BUCKETS, BLOCK_GROUPS * blocks)
    parts = scratch.keep(_bags(source, classes, buckets), "bags", partition_by="kind")
    bags = parts.where("kind = 0").select("block", "doc_id", "n_tokens", "tokens")
    local = scratch.again(parts).where("kind = 1").select("block", "number", "word", "count", "ends")
    counted = scratch.again(parts).where("kind = 2").select("block", "bucket", "grams", "n")
    vocabulary = scratch.keep(local.groupBy("word").agg(F.sum("count").alias("count")), "vocabulary")
    sums = vocabulary.agg(F.sum("count"), F.count(F.when(F.col("count") > 0, 1)), F.count(F.lit(1))).first()
    closed = local.where(F.length("word") == 0).agg(*[F.sum(F.element_at("ends", i + 1)) for i in range(classes)]).first()
    tokens, types, size = sums[0] or 0, sums[1], sums[2]
    documents = np.array([n or 0 for n in closed], float)
    prior = np.log10((documents + 1) / (documents + 1).sum())
    groups = min(buckets, max(1, -(-size // BLOCK_WORDS), BLOCK_GROUPS * blocks))
    short = spark.sparkContext.broadcast(_short_contexts(counted)[:classes])
    scored = _score_grams(counted, short, classes, groups, buckets)
    held = local.select("block", "number", "word").join(vocabulary, "word").select("block", "number", "word", "count")
    right = held.unionByName(scored, allowMissingColumns=True)
    floor = np.log10(tokens + types + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = right.filter(right.column("number").is_valid())
        gram_rows = right.filter(right.column("grams").is_valid())
        count = np.zeros(counts.num_rows, np.int64)
        number = counts.column("number").to_numpy()
        count[number] = counts.column("count").to_numpy()
        words = [b""] * counts.num_rows
        for i, w in zip(number.tolist(), counts.column("word").to_pylist()):
            words[i] = w
        base = np.log10(count + 1.0) - floor
        keys = np.concatenate([_unpacked(g.as_py()) for g in gram_rows.column("grams")])
        log_p = np.concatenate([spread(v.as_py(), np.int32).reshape(classes, -1).T for v in gram_rows.column("log_p")])
        log_p = (log_p * (-1 / STEP)).astype(np.float32)
        scores = Scores(keys, log_p)
        known, bases, out = [], [], []
        waiting: list[bytes] = []
        orders: list[np.ndarray] = []

        def fold() -> None:
            if not orders:
                return
            found, _, place = symbols(waiting)
            by_word = np.add.reduceat(scores(grams(found, place)), np.flatnonzero(place == 0), axis=0, dtype=np.float64)
            index = np.concatenate(orders)
            starts = np.concatenate(([0], np.cumsum([len(o) for o in orders])[:-1]))
            known.append(np.add.reduceat((count[index] > 0).astype(np.int64), starts))
            bases.append(np.add.reduceat(base[index], starts))
            out.append(mixture(by_word, index, starts, prior, strength))
            waiting.clear()
            orders.clear()

        size = 0
        for order in left.column("tokens").to_pylist():
            orders.append(spread(order, np.int32))
            waiting.extend(map(words.__getitem__, orders[-1].tolist()))
            size += 6 * len(orders[-1])
            if size > CHUNK:
                fold()
                size = 0
        fold()
        del scores, keys, log_p, words, counts, gram_rows
        pa.default_memory_pool().release_unused()
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "n_tokens": left.column("n_tokens"),
                "n_known": pa.array(np.concatenate(known)),
                "base_score": pa.array(np.concatenate(bases)),
                "score": pa.array(np.concatenate(out)),
            }
        )

    out = bags.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(finish, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))
