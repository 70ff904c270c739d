r"""Language-model scoring by a hidden Markov model.

Counting: words of all training texts, summed in each task before the shuffle; the whole table of
counts stays distributed. The words from a count upwards that at most `listed` words reach are
listed in the tasks (a fixed bound, found by a histogram of counts); the first `vocabulary` of them
are symbols of their own while training. All other words share `classes` rare symbols by a hash. The
end of a text is a symbol of its own.

Training: Baum-Welch over all training texts. The first passes hold the transition matrix at the
identity, where forward-backward is a sum over a text: from a random start they find states that
whole texts stay in (such as languages). The others start from these states and a transition matrix
that mostly stays, and learn all of start, transitions and emissions. Each kind of pass is repeated
until the training likelihood rises by less than `settled` of itself, or to its most. Each partition
sums expected counts, over many texts at once; partial sums are added as they come, and the driver,
which holds matrices of a fixed size, smooths them into the next model. Texts beyond eight times `piece`
tokens are cut so that their parts run side by side, each with the exact forward state before it and the
backward state behind it, which come from products of the parts' transfer matrices.

Emissions of all words: a last pass of forward-backward sums, for every training word outside the
vocabulary, its expected number of occurrences in each state. This table is as long as the
vocabulary of the corpus and stays distributed. A rare word's probability in a state is its rare
symbol's times the word's smoothed share of that symbol's occurrences in that state, so the
distribution over all words is proper in each state.

Texts are tokenised twice, to count and to write their symbols; training and scoring read the symbols.

Scoring: the scaled forward recursion over the whole text gives its exact log10 likelihood. Listed
words' emissions are in the tasks; those of all other words come by one join on the word, of one row
for each text and distinct word, and go to the text by its row number.

Defined results
* null text: empty, which is the end token alone.
* without training texts N = V = 0: the base score of a token is log10(0.1 / 0.1) = 0 and the
  model is uniform over its symbols.
* a doc_id that repeats: each row is scored on its own and, if in training, counted each time. A null
  doc_id counts as the empty text for the crc32.
* texts of any length: cut texts give the same sums as whole ones; a text's row holds its words and
  their emissions.
* words of equal counts are listed together or not at all, so ties need no order.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import crc_mod, forget, settings, ship, spread, table, tidy, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
VOCABULARY = 20_000
LISTED = 200_000
CLASSES = 64
STATES = 8
FIRST, ITERATIONS = 6, 2
SETTLED = 1e-3
PIECE = 512
STAY = 0.9
ALPHA = 0.1


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.withColumn("held_out", crc_mod("doc_id", 10) == 0)


def _count_partition(batches, most: int):
    """(word, n) of a task's texts; `most` distinct words are held at once."""
    from collections import Counter

    import pyarrow as pa

    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for t in batch.column(0):
            held.update(words(t.as_py()))
            if len(held) >= most:
                yield out()
                held.clear()
    if held:
        yield out()


class _Index(dict):
    """Places of listed words; other words get the next place in `own`."""

    def __missing__(self, word: bytes) -> int:
        return self.own.setdefault(word, len(self.own) + self.first)


class Symbols:
    """Symbols are the first words of the list in order, then the classes of all other words, then the end token. Places of words are those in the list, then, from one behind it, those among the text's own unlisted words.

    words, word_counts: the listed words; class_counts: (tokens, words) that each class has in training; ends: end tokens there."""

    def __init__(self, words: list[bytes], word_counts, vocabulary: int, class_counts: list[tuple[int, int]], ends: int):
        import numpy as np

        self.words, self.vocabulary, self.classes = words, min(vocabulary, len(words)), len(class_counts)
        self.word_counts = np.asarray(word_counts, "f8")
        self.end = self.vocabulary + self.classes
        self.size = self.end + 1
        self.counts = np.concatenate([self.word_counts[: self.vocabulary], [c for c, _ in class_counts], [ends]])
        self.class_total = np.array([c + ALPHA * (v + 1) for c, v in class_counts])
        other = np.array([self.vocabulary + self.class_of(w) for w in words[self.vocabulary :]], "i8")
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        #: the symbol of each listed word
        self.symbol = np.concatenate([np.arange(self.vocabulary), other]).astype(self.kind)
        self._index = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    @property
    def index(self) -> "_Index":
        if self._index is None:
            self._index = _Index((w, i) for i, w in enumerate(self.words))
            self._index.first = len(self.words) + 1
        return self._index

    def class_of(self, word: bytes) -> int:
        return zlib.crc32(word) % self.classes

    def of(self, tokens: list[bytes]):
        """(symbols with the end, places of the words outside the vocabulary, distinct tokens that aren't listed)."""
        import numpy as np

        index, listed = self.index, len(self.words)
        index.own = own = {}
        found = np.array(list(map(index.__getitem__, tokens)), "u4")
        places = found[found >= self.vocabulary]
        symbols = np.empty(len(found) + 1, self.kind)
        own = list(own)
        every = np.array([self.vocabulary + self.class_of(w) for w in own], self.kind)
        mine = found > listed
        symbols[:-1][~mine] = self.symbol[found[~mine]]
        symbols[:-1][mine] = every[found[mine] - listed - 1]
        symbols[-1] = self.end
        return symbols, places, own


class Hmm:
    """start[k], trans[k, l], emit[symbol, k]; each distribution sums to one."""

    def __init__(self, start, trans, emit):
        self.start, self.trans, self.emit = start, trans, emit

    @classmethod
    def first(cls, counts, states: int):
        """From the unigram distribution, disturbed so that states differ; each state stays."""
        import numpy as np

        p = np.asarray(counts, "f8") + ALPHA
        emit = p[:, None] * np.random.default_rng(41).uniform(0.5, 1.5, (len(p), states))
        return cls(np.full(states, 1 / states), np.eye(states), emit / emit.sum(0))

    def forward(self, emissions, lengths):
        """Natural log likelihoods; emissions(t, live): those of the first `live` rows at step t. Rows are in falling order of length."""
        import numpy as np

        n = len(lengths)
        alpha, total = np.repeat(self.start[None, :], n, 0), np.zeros(n)
        for t in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t, "left"))
            a = alpha[:live] if t == 0 else alpha[:live] @ self.trans
            a = a * emissions(t, live)
            c = a.sum(1)
            total[:live] += np.log(c)
            alpha[:live] = a / c[:, None]
        return total

    def staying(self, data, sums):
        """Expected counts of whole texts, added to sums, where the transition matrix is the identity: a text's likelihood in a state is a product. Gives the log likelihood."""
        import numpy as np

        cat, lengths = np.concatenate(data), np.array([len(s) for s in data])
        first = np.cumsum(lengths) - lengths
        log = np.log(self.emit).T.copy()
        each = np.stack([np.add.reduceat(own.take(cat), first) for own in log], 1) + np.log(self.start)
        most = each.max(1, keepdims=True)
        each = np.exp(each - most)
        total = each.sum(1, keepdims=True)
        each /= total
        sums[0] += each.sum(0)
        sums[1] += np.diag((each * (lengths - 1)[:, None]).sum(0))
        for j in range(len(self.start)):
            sums[2][:, j] += np.bincount(cat, np.repeat(each[:, j], lengths), minlength=len(self.emit))
        return float((np.log(total) + most).sum())

    def transfers(self, batch, lengths, first):
        """For each padded piece the matrix that takes the state before it to the state at its end, up to a factor; first: pieces that begin a text, whose first step has no transition. Rows are in falling order of length."""
        import numpy as np

        n, k = len(lengths), len(self.start)
        trans, emit = self.trans.astype("f4"), self.emit.astype("f4")
        out = np.repeat(np.eye(k, dtype="f4")[None], n, 0)
        for t in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t, "left"))
            a = out[:live] if t == 0 else out[:live] @ trans
            if t == 0:
                a = np.where(first[:, None, None], a, trans)
            a = a * emit[batch[:live, t]][:, None, :]
            out[:live] = a / a.sum((1, 2), keepdims=True)
        return out.astype("f8")

    def ends(self, matrices):
        """For the pieces of one text, in order: the state before each (start for the first) and the backward state behind each, scaled so that its product with the forward state there is one."""
        import numpy as np

        before = [self.start]
        for m in matrices:
            a = before[-1] @ m
            before.append(a / a.sum())
        behind = [np.ones(len(self.start))]
        for m in matrices[:0:-1]:
            b = m @ behind[-1]
            behind.append(b / b.sum())
        behind = [b / (a @ b) for a, b in zip(before[1:], behind[::-1])]
        return before[:-1], behind

    def expected(self, batch, lengths, first, sums, before=None, behind=None):
        """Adds the expected counts of padded symbol rows to sums (start, trans, emit), gives their log likelihood and each (step, row) cell's share of states, zero in padding. first: rows that begin a text; the others have the state before them in `before`; `behind` is the backward state."""
        import numpy as np

        n, most = batch.shape
        k = len(self.start)
        top = self.emit.max(1)  # by symbol: what is left is at most one, so that a sum is due every fourth step only
        trans, emits = self.trans.astype("f4"), (self.emit / top[:, None]).astype("f4")[batch.T]  # most, n, k
        lives, last = np.searchsorted(-lengths, -np.arange(most), "left").tolist(), (lengths - 1, np.arange(n))
        emits[np.arange(most)[:, None] >= lengths[None, :]] = 0
        before = np.repeat(self.start[None, :], n, 0) if before is None else before
        begin = np.where(first[:, None], before, before @ self.trans).astype("f4")
        alphas, sums_at = np.zeros((most, n, k), "f4"), {}
        np.multiply(begin, emits[0], out=alphas[0])
        for t in range(1, most):
            a = alphas[t, : lives[t]]
            np.matmul(alphas[t - 1, : lives[t]], trans, out=a)
            a *= emits[t, : lives[t]]
            if t % 4 == 3:
                sums_at[t] = a.sum(1, keepdims=True)
                a /= sums_at[t]
        whole = alphas[last].sum(1, dtype="f8")
        end = np.ones((n, k)) / whole[:, None] if behind is None else behind / (alphas[last] * behind).sum(1, keepdims=True)
        betas, back = np.repeat(end.astype("f4")[None], most, 0), np.ascontiguousarray(trans.T)
        for t in range(most - 1, 0, -1):
            x = emits[t, : lives[t]]
            x *= betas[t, : lives[t]]
            if t in sums_at:
                x /= sums_at[t]
            np.matmul(x, back, out=betas[t - 1, : lives[t]])
        emits[0] *= betas[0]
        moved = alphas[:-1].reshape(-1, k).T @ emits[1:].reshape(-1, k) + before[~first].T @ emits[0][~first]
        alphas *= betas  # now the share of each state
        sums[0] += alphas[0][first].sum(0, dtype="f8")
        sums[1] += moved * self.trans
        if sums[2] is not None:
            at, g = batch.T.ravel(), alphas.reshape(-1, k).T.astype("f8", order="C")
            for j in range(k):
                sums[2][:, j] += np.bincount(at, g[j], minlength=len(self.emit))
        told = np.log(top)[batch].sum(where=np.arange(most)[None, :] < lengths[:, None]) + np.log(whole).sum() + sum(float(np.log(c).sum(dtype="f8")) for c in sums_at.values())
        return float(told), alphas


def _grouped(rows, budget: int):
    """(row, symbols) pairs in padded arrays, in falling order of length; the cells of an array are bounded, long texts are alone."""
    import numpy as np

    def pad(part):
        lengths = np.array([len(s) for _, s in part])
        out = np.zeros((len(part), lengths.max()), "i4")
        for i, (_, s) in enumerate(part):
            out[i, : len(s)] = s
        return [r for r, _ in part], out, lengths

    rows = sorted(rows, key=lambda r: -len(r[1]))
    part: list = []
    for r in rows:
        if part and (len(part) + 1) * len(part[0][1]) > budget:
            yield pad(part)
            part = []
        part.append(r)
    if part:
        yield pad(part)


def _passes(model: Hmm, data: list, piece: int, sums, cells: int = 500_000):
    """Forward-backward over symbol arrays; yields (log likelihood, [(text, place of its first symbol)], lengths, shares) for each padded array."""
    import numpy as np

    long = [i for i, s in enumerate(data) if len(s) > 8 * piece]
    before, behind = {}, {}
    parts = [(i, at) for i in long for at in range(0, len(data[i]), piece)]
    matrices = {}
    for keys, batch, lengths in _grouped([(p, data[p[0]][p[1] : p[1] + piece]) for p in parts], cells):
        matrices.update(zip(keys, model.transfers(batch, lengths, np.array([at == 0 for _, at in keys]))))
    for i in long:
        keys = [(i, at) for at in range(0, len(data[i]), piece)]
        a, b = model.ends([matrices[p] for p in keys])
        before.update(zip(keys, a)), behind.update(zip(keys, b))
    ones, rows = np.ones(len(model.start)), [(p, data[p[0]][p[1] : p[1] + piece]) for p in parts]
    for keys, batch, lengths in _grouped(rows + [((i, 0), s) for i, s in enumerate(data) if len(s) <= 8 * piece], cells):
        first = np.array([at == 0 for _, at in keys])
        told, shares = model.expected(batch, lengths, first, sums, np.stack([before.get(p, model.start) for p in keys]), np.stack([behind.get(p, ones) for p in keys]))
        yield told, keys, lengths, shares


def _symbol_groups(batches, kind: str, tokens: int = 2_000_000):
    """Lists of rows of about `tokens` tokens: their symbols and, where batches have them, places and unlisted words."""
    import numpy as np

    held, size = [], 0
    for batch in batches:
        kinds = (kind, "<u4")
        for row in zip(*batch.columns):
            held.append([np.frombuffer(x.as_buffer(), d) for x, d in zip(row, kinds)] + [x.as_py() for x in row[2:]])
            size += len(held[-1][0])
            if size > tokens:
                yield held
                held, size = [], 0
    if held:
        yield held


def _expect_partition(batches, model: Hmm, size: int, kind: str, piece: int, stay: bool):
    """One row for each slice of the symbols: the partition's expected counts."""
    import numpy as np
    import pyarrow as pa

    k = len(model.start)
    sums, told = [np.zeros(k), np.zeros((k, k)), np.zeros((size, k))], None
    for held in _symbol_groups(batches, kind):
        data = [h[0] for h in held]
        told = (told or 0.0) + (model.staying(data, sums) if stay else sum(r[0] for r in _passes(model, data, piece, sums)))
    if told is not None:
        step = 4096
        rows = [(-1, np.concatenate([[told], sums[0], sums[1].ravel()]).astype("f8").tobytes())] + [(i // step, sums[2][i : i + step].astype("f4").tobytes()) for i in range(0, size, step)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["g", "a"])


def _word_partition(batches, model: Hmm, symbols: Symbols, piece: int, most: int):
    """(word, n, expected number in each state) of the partition's words outside the vocabulary; `most` unlisted ones are held at once."""
    import numpy as np
    import pyarrow as pa

    k, listed, vocabulary = len(model.start), len(symbols.words), symbols.vocabulary
    dense, dense_n = np.zeros((listed - vocabulary, k), "f4"), np.zeros(listed - vocabulary, "i8")
    index: dict[bytes, int] = {}
    own, own_n = np.zeros((0, k), "f4"), np.zeros(0, "i8")

    def out(words, n, g):
        # in 256ths that sum to the word's number: all but one or two are zero, which is little to shuffle
        g = np.floor(g * 256 + 0.5) / 256
        g[np.arange(len(g)), g.argmax(1)] += n - g.sum(1)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array(g[:, j].astype("f4"), pa.float32()) for j in range(k)]], names=["word", *[f"g{j}" for j in range(k)]])

    ignored = [np.zeros(k), np.zeros((k, k)), None]

    def outside(own_symbols):
        return int(((own_symbols >= vocabulary) & (own_symbols < symbols.end)).sum())

    def add(at, g, to, n):
        for j in range(k):
            to[:, j] += np.bincount(at, g[:, j], minlength=len(to))
        n += np.bincount(at, minlength=len(n))

    for held in _symbol_groups(batches, symbols.kind):
        places = [np.array([index.setdefault(w, len(index)) for w in rare], "i8") for _, _, rare in held]
        if len(index) > len(own):
            more = len(index) - len(own)
            own, own_n = np.concatenate([own, np.zeros((more, k), "f4")]), np.concatenate([own_n, np.zeros(more, "i8")])
        for _, keys, lengths, shares in _passes(model, [h[0] for h in held], piece, ignored):
            cells, at = [], []
            for row, (i, start) in enumerate(keys):
                own_symbols = held[i][0][start : start + lengths[row]]
                steps = np.flatnonzero((own_symbols >= vocabulary) & (own_symbols < symbols.end))
                skipped = outside(held[i][0][:start]) if start else 0
                codes = held[i][1][skipped : skipped + len(steps)].astype("i8")
                rare = codes > listed
                codes[rare] = places[i][codes[rare] - listed - 1] + listed + 1
                cells.append(steps * len(keys) + row), at.append(codes)
            at, g = np.concatenate(at), shares.reshape(-1, k)[np.concatenate(cells)]
            rare = at > listed
            add(at[~rare] - vocabulary, g[~rare], dense, dense_n)
            add(at[rare] - listed - 1, g[rare], own, own_n)
        if len(index) >= most:
            yield out(list(index), own_n, own)
            index, own, own_n = {}, own[:0], own_n[:0]
    if index:
        yield out(list(index), own_n, own)
    there = np.flatnonzero(dense_n)
    if len(there):
        yield out([symbols.words[vocabulary + i] for i in there], dense_n[there], dense[there])


def _add_slices(batches):
    """Partial sums, sorted by slice, added as they come: one sum at a time is held."""
    import numpy as np
    import pyarrow as pa

    now, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "a"])

    for batch in batches:
        for g, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(v.as_buffer(), "f8" if g < 0 else "f4").astype("f8")
            if g == now:
                total += part
            else:
                if now is not None:
                    yield out()
                now, total = g, part
    if now is not None:
        yield out()


def train(rows: DataFrame, symbols: Symbols, *, states: int = STATES, first: int = FIRST, iterations: int = ITERATIONS, settled: float = SETTLED, piece: int = PIECE) -> Hmm:
    """rows: symbols. Each iteration is a pass over all of them; the sums are of a fixed size."""
    import numpy as np

    spark = rows.sparkSession
    model = Hmm.first(symbols.counts, states)
    unigram = np.asarray(symbols.counts, "f8") + ALPHA
    unigram /= unigram.sum()
    size, kind = symbols.size, symbols.kind
    for stay, most in ((True, first), (False, iterations)):
        before = None
        for _ in range(most):
            shared = spark.sparkContext.broadcast(model)
            parts = rows.select("symbols").mapInArrow(lambda b, s=shared, stay=stay: tidy(_expect_partition(b, s.value, size, kind, piece, stay)), "g int, a binary")
            added = {r["g"]: np.frombuffer(r["a"], "f8") for r in parts.repartition("g").sortWithinPartitions("g").mapInArrow(_add_slices, "g int, a binary").collect()}
            shared.unpersist()
            if not added:
                return model
            told, head = added[-1][0], added.pop(-1)[1:]
            start, trans = head[:states] + 1, head[states:].reshape(states, states) + 1
            emit = np.maximum(np.concatenate([added[g] for g in sorted(added)]).reshape(-1, states), 0) + 50 * unigram[:, None]
            trans = np.eye(states) if stay else trans / trans.sum(1, keepdims=True)
            model = Hmm(start / start.sum(), trans, emit / emit.sum(0))
            if before is not None and told - before < settled * abs(told):
                break
            before = told
        if stay:
            model.trans = STAY * np.eye(states) + (1 - STAY) * model.start[None, :]
    return model


def word_states(rows: DataFrame, symbols: Symbols, model: Hmm, *, piece: int = PIECE, distinct: int = 400_000) -> DataFrame:
    """word, c, class, g (its expected number in each state) of all training words outside the vocabulary; a written table. rows: symbols, places, rare."""
    spark, k = rows.sparkSession, len(model.start)
    known, shared = spark.sparkContext.broadcast(symbols), spark.sparkContext.broadcast(model)
    schema = "word binary, " + ", ".join(f"g{j} float" for j in range(k))
    parts = rows.select("symbols", "places", "rare").mapInArrow(lambda b: tidy(_word_partition(b, shared.value, known.value, piece, distinct)), schema)
    sums = parts.groupBy("word").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(k)])
    sums = sums.withColumn("c", F.round(sum((F.col(f"g{j}") for j in range(k)), F.lit(0.0))).cast("long"))
    class_of = F.pmod(F.crc32("word"), F.lit(symbols.classes)).cast("int")
    return written(sums.select("word", "c", class_of.alias("class"), F.array(*[F.col(f"g{j}").cast("float") for j in range(k)]).alias("g")), "words")


class Emissions:
    """Emissions of all words: of listed ones as a matrix, of others out of their rows in word_states."""

    def __init__(self, symbols: Symbols, model: Hmm, class_states, listed: dict[bytes, list[float]]):
        import numpy as np

        self.symbols, self.model = symbols, model
        total = class_states.sum(1, keepdims=True)
        # how much more of a class's occurrences all states have than each has
        self.lift = np.where(class_states > 0, total / np.maximum(class_states, 1e-9 * np.maximum(total, 1)), 0.0)
        self.matrix = np.empty((len(symbols.words) + 1, len(model.start)))
        self.matrix[: symbols.vocabulary], self.matrix[-1] = model.emit[: symbols.vocabulary], model.emit[symbols.end]
        rest = symbols.words[symbols.vocabulary :]
        if rest:
            zero = [0.0] * len(model.start)
            g = np.array([listed.get(w, zero) for w in rest], "f8")
            self.matrix[symbols.vocabulary : -1] = self.rare(np.array([symbols.class_of(w) for w in rest]), g)

    def rare(self, classes, g):
        """P(word | state) for words outside the vocabulary with these classes and expected numbers; zeros for an unknown one."""
        import numpy as np

        m = self.model.emit[self.symbols.vocabulary + classes]
        lift = self.lift[classes]
        # states without any of the class have the shares of all states
        share = np.where(lift > 0, g * lift, g.sum(1, keepdims=True)) + ALPHA
        return m * share / self.symbols.class_total[classes][:, None]


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, places binary, rare array<binary>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _encode_partition(batches, symbols: Symbols):
    """For each row its symbols, places and distinct unlisted words."""
    import numpy as np
    import pyarrow as pa

    def out(held):
        row, doc_id, held_out, codes, places, rare = zip(*held)
        offsets = pa.array(np.cumsum([0, *map(len, rare)], dtype="i4"))
        names = pa.array([w for r in rare for w in r], pa.binary())
        cols = [pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(list(map(len, codes)), pa.int64()), pa.array([s.tobytes() for s in codes], pa.binary()), pa.array([p.tobytes() for p in places], pa.binary()), pa.ListArray.from_arrays(offsets, names)]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in ENCODED.split(", ")])

    held, size = [], 0
    for batch in batches:
        ids = [batch.column(i).to_pylist() for i in (0, 1, 3)]
        for row, doc_id, held_out, t in zip(*ids, batch.column(2)):
            held.append((row, doc_id, held_out, *symbols.of(words(t.as_py()))))
            size += len(held[-1][3])
            if size > 500_000:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


def _score_partition(batches, emissions: Emissions, n: int, v: int, cells: int = 500_000):
    """SCORED; batches: doc_id, held_out, n_tokens, symbols, places, n_rare, found (place in rare, c, g)."""
    import numpy as np
    import pyarrow as pa

    symbols, model = emissions.symbols, emissions.model
    listed, k, below = len(symbols.words), len(model.start), n + ALPHA * (v + 1)
    counts = np.concatenate([symbols.word_counts, symbols.counts[-1:]])
    log = np.log10((counts + ALPHA) / below)

    def out(held):
        meta, codes, rare, base, known = zip(*held)
        scores = np.zeros(len(held))
        for keys, padded, lengths in _grouped(list(enumerate(codes)), cells):
            first = np.cumsum([0, *(len(rare[r]) for r in keys)])
            more = np.concatenate([rare[r] for r in keys])
            padded = padded.astype("i8")
            own = padded > listed
            padded = np.where(own, padded + (first[:-1] - listed - 1)[:, None], padded)

            def at(t, live, padded=padded, own=own, more=more):
                here, mine = padded[:live, t], own[:live, t]
                if not mine.any():
                    return emissions.matrix[here]
                found = emissions.matrix[np.where(mine, 0, here)]
                found[mine] = more[here[mine]]
                return found

            scores[keys] = model.forward(at, lengths)
        ids, held_out, n_tokens = zip(*meta)
        cols = [pa.array(ids, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores / np.log(10))]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ")])

    held, size = [], 0  # batches are small, as their nested lists take much room; texts are scored many at once
    for batch in batches:
        column = {f: batch.column(6).flatten().field(f) for f in ("i", "c", "g")}
        sizes = np.concatenate([[0], np.cumsum(batch.column(6).value_lengths().to_numpy())])
        at_of, c_of = column["i"].to_numpy(), column["c"].to_numpy()
        g_of = column["g"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        meta = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        for r, (s, p, n_rare) in enumerate(zip(batch.column(3), batch.column(4), batch.column(5).to_pylist())):
            codes, places = np.frombuffer(s.as_buffer(), symbols.kind).astype("u4"), np.frombuffer(p.as_buffer(), "<u4")
            outside = np.flatnonzero((codes >= symbols.vocabulary) & (codes < symbols.end))
            classes, mine = np.zeros(n_rare, "i8"), places > listed
            classes[places[mine] - listed - 1] = codes[outside[mine]] - symbols.vocabulary
            codes[outside], codes[-1] = places, listed
            own_c, own_g = np.zeros(n_rare), np.zeros((n_rare, k))
            part = slice(sizes[r], sizes[r + 1])
            own_c[at_of[part]], own_g[at_of[part]] = c_of[part], g_of[part]
            mine, theirs = codes[codes > listed] - listed - 1, codes[codes <= listed]
            base = float(log[theirs].sum() + np.log10((own_c + ALPHA) / below)[mine].sum())
            known = int((counts[theirs] > 0).sum() + (own_c > 0)[mine].sum())
            held.append((meta[r], codes, emissions.rare(classes, own_g) if n_rare else np.empty((0, k)), base, known))
            size += len(codes)
        if size > 1_500_000:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def _cut(counts: DataFrame, listed: int) -> int:
    """The least count that at most `listed` words reach, out of a histogram of counts: exact up to 4096, by 64ths of an octave beyond."""
    place = F.when(F.col("c") <= 4096, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 4096 - 12 * 64 + 1)
    cells = counts.groupBy(place.cast("long").alias("p")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("c")).orderBy(F.col("p").desc()).collect()  # 8,000 rows at most
    cut, words_ = (1 << 62), 0
    for r in cells:
        words_ += r["words"]
        if words_ > listed:
            break
        cut = r["c"]
    return cut


def hmm_scores(docs: DataFrame, *, vocabulary: int = VOCABULARY, listed: int = LISTED, classes: int = CLASSES, states: int = STATES, first: int = FIRST, iterations: int = ITERATIONS, settled: float = SETTLED, piece: int = PIECE, distinct: int = 400_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; learns from rows whose crc32(doc_id as text) mod 10 is not 0."""
    import numpy as np

    spark = docs.sparkSession
    ship(spark)
    rows = spread(_plain(docs, doc_id, text))
    learn = rows.filter("not held_out").select("text")
    counts = learn.mapInArrow(lambda b: tidy(_count_partition(b, distinct)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = written(counts, "counts")
    ends = learn.count()
    told = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    n, v = told["n"] + ends, told["v"] + (ends > 0)
    cut = _cut(counts, max(listed, vocabulary))
    top = counts.filter(F.col("c") >= cut).toArrow()  # at most `listed` words
    top = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist()), key=lambda r: (-r[0], r[1]))
    class_of = F.pmod(F.crc32("word"), F.lit(classes)).cast("int")
    by_class = [[0, 0] for _ in range(classes)]
    for r in counts.filter(F.col("c") < cut).groupBy(class_of.alias("class")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        by_class[r["class"]] = [r["n"], r["v"]]
    for c, w in top[vocabulary:]:
        own = by_class[zlib.crc32(w) % classes]
        own[0], own[1] = own[0] + c, own[1] + 1
    symbols = Symbols([w for _, w in top], [c for c, _ in top], vocabulary, [tuple(x) for x in by_class], ends)
    forget(counts)
    known = spark.sparkContext.broadcast(symbols)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    encoded = written(numbered.mapInArrow(lambda b: tidy(_encode_partition(b, known.value)), ENCODED), "encoded")
    learn = encoded.filter("not held_out")
    model = train(learn, symbols, states=states, first=first, iterations=iterations, settled=settled, piece=piece)
    own = word_states(learn, symbols, model, piece=piece, distinct=distinct)
    class_states = np.zeros((classes, states))
    for r in own.groupBy("class").agg(*[F.sum(F.col("g")[j].cast("double")).alias(f"g{j}") for j in range(states)]).collect():
        class_states[r["class"]] = [r[f"g{j}"] for j in range(states)]
    few = own.filter(F.col("c") >= cut).select("word", "g").toArrow()  # at most `listed` words
    emissions = spark.sparkContext.broadcast(Emissions(symbols, model, class_states, dict(zip(few.column("word").to_pylist(), few.column("g").to_pylist()))))
    rare = encoded.select("row", F.posexplode("rare").alias("i", "word"))
    found = rare.join(own.filter(F.col("c") < cut).select("word", "c", "g"), "word").groupBy("row").agg(F.collect_list(F.struct("i", "c", "g")).alias("found"))  # as many as a text has distinct words
    none = F.array().cast("array<struct<i:int,c:bigint,g:array<float>>>")
    plain = encoded.select("row", "doc_id", "held_out", "n_tokens", "symbols", "places", F.size("rare").alias("n_rare"))
    each = plain.join(found, "row", "left").select("doc_id", "held_out", "n_tokens", "symbols", "places", "n_rare", F.coalesce("found", none).alias("found"))
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}):  # nested lists take much room in a batch
        scored = written(each.mapInArrow(lambda b: tidy(_score_partition(b, emissions.value, n, v)), SCORED), "scored")
    forget(encoded), forget(own)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))
