"""Secret scans: fixed patterns, and a character convolutional network over
every candidate with its surroundings.

Base findings come from three patterns and always stay. Candidates are the
base findings and every run of at least ``MIN_RUN`` token characters with a
letter and a digit; the network looks at views of ``WIDTH`` characters, one
every ``STEP`` from the candidate's start until ``LEFT`` characters behind its
end are seen. A candidate's score is the highest of its views; candidates that
score above the threshold and overlap no base finding are added.

Training uses all distinct labelled findings of all documents: base findings
are positive, other candidates and plain words are negative. Every positive is
also learned without its context (it is swapped with that of a negative), so
the network learns the characters of a secret and not only the keyword before
it. All views of a negative are negative; a positive is learned from its first
view. A candidate trains with at most ``TRAIN_VIEWS`` views, spread over it.

The candidates are dealt by hash to learners of about ``LEARNER`` each. In
each epoch every learner goes over its own, from the mean of what all learners
had after the epoch before. Rare positives weigh more. On every ``HELD_OUT``-th
candidate by hash the scores are calibrated (logistic), and the threshold is
the highest that still finds ``RECALL`` of the held-out positives; logits of
all held-out rows are counted in steps of 1 / ``LOGIT_STEPS`` for it. The model
holds the recall and precision reached there and the numbers of candidates seen.

Positions count code points of the whole text, ends exclusive. A null text
counts as empty. Repeated rows are scanned alike; other columns pass through,
existing result columns are replaced. Without positives nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.arrow import append_columns, bytes_of, slices
from nightjar.session import checkpoint_dir

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")

MIN_RUN = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEFT, WIDTH, STEP = 20, 64, 22
TRAIN_VIEWS = 4
VIEW_BLOCK = 4_096      # views scored at once
LEARNER = 32_768        # candidates of a learner, about
HELD_OUT = 5
LOGIT_STEPS, LOGIT_MOST = 1_024, 64
RECALL = 0.98
FILTERS, SPAN, EPOCHS, SEED, BATCH = 24, 5, 8, 11, 64


def _marks(chars: str) -> bytes:
    return bytes(1 if chr(b) in chars and b < 128 else 0 for b in range(256))


_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_HEX_MARK = _marks(_DIGITS + "abcdef")
_RUN_MARK = _marks(_DIGITS + _LOWER + _LOWER.upper() + "+/_=-")


def base_findings(raw: bytes, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost and non-overlapping per kind."""
    out = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"\x01" * 24 in raw.translate(_HEX_MARK):
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def other_candidates(raw: bytes, text: str, found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters with a letter and a digit that overlap no finding."""
    if b"\x01" * MIN_RUN not in raw.translate(_RUN_MARK):
        return []
    out = []
    for m in RUN.finditer(text):
        run, (s, e) = m.group(), m.span()
        if (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
                and not any(a < e and s < b for _, a, b in found)):
            out.append((s, e))
    return out


def _classes() -> np.ndarray:
    """Character class of each code point below 128; the last class is for the rest."""
    groups = ["0", "123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " ", "\n\t\r",
              "=:", "\"'`", "+/", "_-", ".,;!?", "()[]{}<>|"]
    table = np.full(129, len(groups), dtype=np.int64)
    for i, g in enumerate(groups):
        table[[ord(c) for c in g]] = i
    return table


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 2      # one more: beyond the text's ends


def classes(text: str, low: int, high: int) -> np.ndarray:
    """Classes of the characters from ``low`` to ``high``, also beyond the text's ends."""
    codes = np.full(high - low, N_CLASSES - 1, dtype=np.uint8)
    part = text[max(0, low):high]
    points = np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128)
    at = max(0, low) - low
    codes[at:at + len(points)] = CLASSES[points]
    return codes


def view(text: str, start: int) -> np.ndarray:
    """Classes of the ``WIDTH`` characters from ``LEFT`` before ``start``."""
    return classes(text, start - LEFT, start - LEFT + WIDTH).astype(np.int64)


def view_starts(start: int, end: int) -> range:
    """Where the views of a candidate stand: the last sees ``LEFT`` characters behind its end."""
    return range(start, max(start + 1, end + 2 * LEFT - WIDTH + STEP), STEP)


def views(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """All views of a candidate, in blocks of at most ``VIEW_BLOCK`` rows."""
    starts = view_starts(start, end)
    for at in range(0, len(starts), VIEW_BLOCK):
        part = starts[at:at + VIEW_BLOCK]
        seen = classes(text, part[0] - LEFT, part[-1] - LEFT + WIDTH)
        yield np.lib.stride_tricks.sliding_window_view(seen, WIDTH)[::STEP]


def training_views(text: str, start: int, end: int) -> bytes:
    """Up to ``TRAIN_VIEWS`` views: the first and the last, others between."""
    starts = view_starts(start, end)
    n = min(TRAIN_VIEWS, len(starts))
    chosen = [starts[i * (len(starts) - 1) // max(1, n - 1)] for i in range(n)]
    return b"".join(classes(text, c - LEFT, c - LEFT + WIDTH).tobytes() for c in chosen)


class CharCNN:
    """Embedding by one-hot classes, one convolution, maxima over context and
    over the candidate, one logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {"k": rng.normal(0, 0.3, (SPAN, N_CLASSES, FILTERS)), "c": np.zeros(FILTERS),
                  "w": rng.normal(0, 0.3, 2 * FILTERS), "b": np.zeros(1)}
        self.m, self.v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        self.step = 0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0
        self.recall = self.precision = None     # on the held-out rows
        self.seen = None        # positive and negative candidates learned from or held out

    def _forward(self, x: np.ndarray) -> tuple:
        n_pos = WIDTH - SPAN + 1
        h = np.zeros((len(x), n_pos, FILTERS)) + self.p["c"]
        for j in range(SPAN):
            h += self.p["k"][j][x[:, j:j + n_pos]]
        h = np.maximum(h, 0)
        where = np.stack([h[:, :LEFT].argmax(1), h[:, LEFT:].argmax(1) + LEFT], axis=1)
        top = np.take_along_axis(h, where, axis=1).reshape(len(x), -1)
        return where, top, top @ self.p["w"] + self.p["b"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of each view; of each candidate, the highest, where ``x`` is (candidates, views, characters)."""
        if x.ndim == 3:
            return self.logits(x.reshape(-1, WIDTH)).reshape(x.shape[:2]).max(1)
        return np.concatenate([self._forward(x[i:i + 512])[2] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> "CharCNN":
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            self.learn(x, y, np.ones(len(x)), rng)
        return self

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over views, in random order."""
        order = rng.permutation(len(x))
        spans = np.arange(SPAN)
        cells = (spans * N_CLASSES)[:, None]
        for at in range(0, len(x), BATCH):
            rows = order[at:at + BATCH]
            seen = x[rows]
            where, top, z = self._forward(seen)
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / weight[rows].sum()
            dtop = np.outer(dz, self.p["w"]) * (top > 0)
            # Class of each character under each maximum's filter: (rows, 2 x filters, span).
            under = seen[np.arange(len(rows))[:, None, None], where.reshape(len(rows), -1, 1) + spans].astype(np.int64)
            cell = (under + cells[:, 0]) * FILTERS + np.tile(np.arange(FILTERS), 2)[:, None]
            k = np.bincount(cell.reshape(-1), np.repeat(dtop.reshape(-1), SPAN), SPAN * N_CLASSES * FILTERS)
            grad = {"w": top.T @ dz, "b": np.array([dz.sum()]), "c": dtop.reshape(len(rows), 2, FILTERS).sum((0, 1)),
                    "k": k.reshape(SPAN, N_CLASSES, FILTERS)}
            self.step += 1
            for name, g in grad.items():
                g = g + 1e-4 * self.p[name]
                m = self.m[name] = 0.9 * self.m[name] + 0.1 * g
                v = self.v[name] = 0.999 * self.v[name] + 0.001 * g * g
                self.p[name] = self.p[name] - 5e-3 * (m / (1 - 0.9 ** self.step)) / (np.sqrt(v / (1 - 0.999 ** self.step)) + 1e-8)

    def state(self) -> np.ndarray:
        """Weights, their moments and the steps made, in a row."""
        return np.concatenate([a.reshape(-1) for part in (self.p, self.m, self.v) for a in part.values()] + [[self.step]])

    def resume(self, state: np.ndarray) -> "CharCNN":
        at = 0
        for part in (self.p, self.m, self.v):
            for name, a in part.items():
                part[name] = state[at:at + a.size].reshape(a.shape)
                at += a.size
        self.step = round(state[at])
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> "CharCNN":
        """``calibrate_on`` the logits of held-out rows."""
        return self.calibrate_on(self.logits(x), y, np.ones(len(x)), recall)

    def calibrate_on(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = RECALL) -> "CharCNN":
        """Logistic calibration on logits of held-out rows, ``n`` of each, then
        the highest threshold that keeps ``recall`` of their positives."""
        a, b, share = 1.0, 0.0, n / n.sum()
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g, h = share * (p - y), share * p * (1 - p)
            slope = np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()])
            bend = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
            da, db = np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
            a, b = max(a - da, 1e-3), b - db     # a higher logit is never a lower score
        self.scale, self.shift = float(a), float(b)
        scores = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        order = np.argsort(scores, kind="stable")
        order = order[y[order] == 1]
        upto = np.cumsum(n[order])
        # As many positives may be missed as recall leaves.
        self.threshold = float(scores[order[np.searchsorted(upto, int((1 - recall) * upto[-1] + 1e-9), "right")]]) if len(order) else 2.0
        if len(order):
            found = scores >= self.threshold
            self.recall = float(n[found & (y == 1)].sum() / upto[-1])
            self.precision = float(n[found & (y == 1)].sum() / n[found].sum())
        return self


def labelled_views(raw: bytes) -> list[tuple[int, bytes]]:
    """(label, views) of a document's candidates; up to two plain words are negatives too."""
    text = raw.decode("utf-8", "replace")
    found = base_findings(raw, text)
    out = []
    for kind, s, e in found:
        # The secret itself starts after the keyword of an assignment.
        at = ASSIGN.match(text, s).start(2) if kind == "assign" else s
        out.append((1, training_views(text, at, e)))
    out += [(0, training_views(text, s, e)) for s, e in other_candidates(raw, text, found)]
    for share in (1, 2):
        at = text.find(" ", len(text) * share // 3) + 1
        if at and not any(a <= at + WIDTH and at - LEFT < b for _, a, b in found):
            out.append((0, training_views(text, at, at + 1)))
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [row for raw in bytes_of(part, "text") for row in labelled_views(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["label", "view"])


def _swapped(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Findings in the context of other candidates."""
    first = (pos == pos[:, :1]).all(2)
    swapped = pos.copy()
    # From any of the negative's views: a secret may stand behind other characters of its run.
    i = np.arange(len(pos))
    swapped[:, 0, :LEFT] = neg[i % len(neg), i % neg.shape[1], :LEFT]
    return np.where(first[:, :, None], swapped[:, :1], swapped)


def _single(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The views to learn: the first of each candidate, and the others of negatives."""
    # A repeated first view is a filler.
    more = [v[(v != x[:, 0]).any(1) & (y == 0)] for v in x.transpose(1, 0, 2)[1:]]
    return np.concatenate([x[:, 0], *more]), np.concatenate([y, np.zeros(sum(map(len, more)))])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int]]]:
    """(views, labels, positive and negative candidates) of each batch; findings
    also in the context of the batch's other candidates, or of those before."""
    before = None
    for batch in batches:
        held = batch.column("view").to_pylist()
        # The first view fills what a candidate lacks.
        x = np.frombuffer(b"".join(v + v[:WIDTH] * (TRAIN_VIEWS - len(v) // WIDTH) for v in held), np.uint8)
        x, label = x.reshape(-1, TRAIN_VIEWS, WIDTH), batch.column("label").to_numpy()
        pos, neg = x[label == 1], x[label == 0]
        before = neg if len(neg) else before
        found = [pos] if before is None or not len(pos) else [pos, _swapped(pos, before)]
        y = np.concatenate([np.ones(len(pos) * len(found)), np.zeros(len(neg))])
        if len(y):
            yield np.concatenate([*found, neg]), y, (len(pos), len(neg))


def _epoch(shared, nth: int, weight: float):
    """One learner's pass over its candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CharCNN().resume(shared.value)
        rng = np.random.default_rng((SEED, nth, TaskContext.get().partitionId()))
        n, seen = 0, np.zeros(2, dtype=np.int64)
        for x, y, counts in _examples(batches):
            x, y = _single(x, y)
            model.learn(x, y, np.where(y == 1, weight, 1.0), rng)
            n, seen = n + len(y), seen + counts
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([c]) for c in seen.tolist()), pa.array([model.state().tobytes()])],
                                             names=["n", "positive", "negative", "state"])

    return run


def _logits(shared):
    """How often a logit's step occurs among a task's positives and negatives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CharCNN().resume(shared.value)
        for x, y, (pos, neg) in _examples(batches):
            at = np.floor(np.clip(model.logits(x), -LOGIT_MOST, LOGIT_MOST) * LOGIT_STEPS).astype(np.int64)
            (label, step), n = np.unique(np.stack([y.astype(np.int64), at]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(step), pa.array(n.astype(np.int64)),
                                              *(pa.array([c] + [0] * (len(n) - 1), pa.int64()) for c in (pos, neg))],
                                             names=["label", "step", "n", "positive", "negative"])

    return run


def train(docs: DataFrame) -> CharCNN | None:
    """Fit, calibrate and set the threshold; None if the table has no finding."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    texts = docs.where("text IS NOT NULL").select(F.col("text").cast("binary").alias("text"))
    by = F.xxhash64("view", "label")
    rows = (texts.mapInArrow(_candidates, "label int, view binary").distinct()
            .select("label", "view", by.alias("by"), (F.pmod(by, F.lit(HELD_OUT)) == 0).alias("held")).checkpoint())
    counts = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    n = [sum(c for (label, _), c in counts.items() if label == y) for y in (0, 1)]
    if not all(n):
        return None
    # The same learners and the same order in every run, whatever the input's partitions.
    rows = rows.repartition(-(-sum(n) // LEARNER), "by").sortWithinPartitions("by", "label", "view").checkpoint()
    learned, held = rows, rows
    if len(counts) == 4:        # otherwise there are too few to hold any out
        learned, held = rows.where("NOT held"), rows.where("held")
        n = [counts[0, False], counts[1, False]]
    # A positive is learned twice; more than a whole batch it never weighs.
    weight = min(max(1.0, n[0] / (2 * n[1])), float(BATCH))
    model = CharCNN()
    for nth in range(EPOCHS):
        shared = spark.sparkContext.broadcast(model.state())
        got = learned.select("label", "view").mapInArrow(
            _epoch(shared, nth, weight), "n long, positive long, negative long, state binary").collect()
        model.resume(np.average([np.frombuffer(r["state"]) for r in got], axis=0, weights=[r["n"] for r in got]))
        shared.unpersist()
    shared = spark.sparkContext.broadcast(model.state())
    steps = (held.select("label", "view").mapInArrow(_logits(shared), "label long, step long, n long, positive long, negative long")
             .groupBy("label", "step").agg(*(F.sum(c).alias(c) for c in ("n", "positive", "negative"))).orderBy("label", "step").collect())
    label, step, times, *tested = np.array(steps, dtype=np.int64).T
    model.calibrate_on(step / LOGIT_STEPS, label.astype(float), times.astype(float))
    model.seen = tuple(sum(r[c] for r in got) + (int(t.sum()) if held is not rows else 0)
                       for c, t in zip(("positive", "negative"), tested))
    return model


def fit_on(pos: np.ndarray, neg: np.ndarray) -> CharCNN:
    """Fit on the views of findings and of other candidates (one view each, or
    several as (candidates, views, characters)); every finding is seen in its
    own context and in that of another candidate."""
    pos, neg = (a[:, None] if a.ndim == 2 else a for a in (pos, neg))
    swapped = _swapped(pos, neg)
    # Every fifth candidate, and its swapped version, is held out.
    held_pos, held_neg = np.arange(len(pos)) % HELD_OUT == 0, np.arange(len(neg)) % HELD_OUT == 0
    if (held_pos.all() and held_neg.all()) or not (held_pos.any() or held_neg.any()):
        held_pos[:] = held_neg[:] = False

    def rows(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, other = pos[p], swapped[p]
        return np.concatenate([own, other, neg[n]]), np.concatenate([np.ones(2 * len(own)), np.zeros(int(n.sum()))])

    held = rows(held_pos, held_neg) if held_pos.any() or held_neg.any() else rows(~held_pos, ~held_neg)
    return CharCNN().fit(*_single(*rows(~held_pos, ~held_neg))).calibrate(*held)


_FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                         T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


def scan(docs: DataFrame, model: CharCNN | None) -> DataFrame:
    """``docs`` with ``findings``: array of (kind, start, end, score), by start
    and then kind. Base findings have kind assign, access or hex; what the
    network adds has kind model."""
    def run(raws: list[bytes]) -> dict:
        found, held, owners, best = [], [], [], {}

        def score() -> None:
            if held:
                for o, p in zip(owners, model.scores(np.concatenate(held).astype(np.int64)).tolist()):
                    best[o] = max(p, best.get(o, 0.0))
                held.clear()
                owners.clear()

        for i, raw in enumerate(raws):
            text = raw.decode("utf-8", "replace")
            base = base_findings(raw, text)
            found.append([{"kind": k, "start": s, "end": e, "score": None} for k, s, e in base])
            if model is None:
                continue
            spans = [(j, ASSIGN.match(text, s).start(2) if k == "assign" else s, e) for j, (k, s, e) in enumerate(base)]
            for j, s, e in [*spans, *((None, s, e) for s, e in other_candidates(raw, text, base))]:
                for block in views(text, s, e):
                    held.append(block)
                    owners.extend([(i, j, s, e)] * len(block))
                    if len(owners) >= VIEW_BLOCK:
                        score()
        score()
        for (i, j, s, e), p in best.items():
            if j is not None:
                found[i][j]["score"] = p
            elif p >= model.threshold:
                found[i].append({"kind": "model", "start": s, "end": e, "score": p})
        for f in found:
            f.sort(key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))
        return {"findings": found}

    return append_columns(docs, "text", run, [T.StructField("findings", T.ArrayType(_FINDING))])
