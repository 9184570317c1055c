"""Personal data by fixed patterns and a character-level BiLSTM-CRF (operator 2).

Base spans (email, ip, card, phone) come from fixed patterns in every whole
text and are always kept. The tagger adds spans that the patterns miss:
numbers and addresses written with other separators.

* Labelled spans: the base spans of the corpus, shown to the tagger as they are and rewritten
  (separators changed, ``+`` and country code left out, ``@`` spaced or spelt ``(at)``).
  ``SAMPLE_WINDOWS`` windows with and as many without a span are drawn by
  the smallest hashes of their contents - the bound on the training data,
  whatever the size of the corpus.
* Windows: ``WINDOW`` characters every ``WINDOW / 2``. Every kind of span holds a digit
  or an ``@``/``(at)``, so windows without one are not decoded; by that definition they hold
  no span. Texts of any length are read whole.
* Reconciliation: spans of overlapping windows are merged where a window's
  edge cut one of them; of all that is left in a document, the set of
  non-overlapping spans with the greatest summed confidence stays (weighted
  interval scheduling over the whole document).
* An added span must be sure (mean marginal of at least ``SURE``), satisfy its
  kind's check (Luhn, parts up to 255, digits) and overlap no base span.

Null and empty texts have no spans. Ids are carried through, repeated rows
get equal results; an empty table gives an empty one (no model is trained).
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.session import cut_lineage

from .lstm_crf import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
SAMPLE_WINDOWS = 500
EPOCHS = 12
SURE = 0.9
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
# decoded at once in a task
DECODE_ROWS = 2048

# --------------------------------------------------------- the base patterns
# Fixed patterns; written so that each is searched in time linear in the text:
# an email is grown from its "@", runs of digits are entered at their start only.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    out = [(0, a, z) for a, z in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# ------------------------------------------------------------------ training
def window_starts(text: str, anchor: re.Pattern = _SOME) -> list[int]:
    """Starts of the windows that hold an anchor."""
    step, out = WINDOW // 2, []
    last = -1
    for m in anchor.finditer(text):
        k = m.start() // step
        for j in (k - 1, k):
            if j > last and j >= 0:
                out.append(j * step)
                last = j
    return out


def tag_window(spans: list[tuple[int, int, int]], start: int) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int64)
    for kind, a, z in spans:
        lo, hi = max(a, start) - start, min(z, start + WINDOW) - start
        if lo < hi:
            tags[lo:hi] = 2 + 2 * kind
            if a >= start:
                tags[lo] = 1 + 2 * kind
    return tags


def _windows(seed: int, most: int):
    """Texts -> the ``most`` windows of smallest hash with and without a span, per task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[], []]
        for b in batches:
            for text in b.column("_text").to_pylist():
                if not text or not _SOME.search(text):
                    continue
                spans = base_spans(text)
                edges = sorted((a, z) for _, a, z in spans)
                for start in window_starts(text):
                    piece = text[start:start + WINDOW]
                    at = bisect.bisect_left(edges, (start + WINDOW,))
                    has = int(any(z > start for _, z in edges[max(0, at - 8):at]))
                    rank = xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass"), seed)
                    entry = (-rank, piece, tag_window(spans, start).astype(np.int8).tobytes())
                    heap = heaps[has]
                    if len(heap) < most:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        every = [(has, -r - 2**63, p, t) for has in (0, 1) for r, p, t in heaps[has]]
        cols = list(zip(*every)) if every else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.string(), pa.binary()))],
            ["has", "rank", "piece", "tags"])

    return rows


def labelled_windows(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_WINDOWS,
                     seed: int = 2) -> DataFrame:
    """(has, rank, piece, tags): at most 2 * ``most`` labelled windows of the whole
    corpus, equal for equal corpora."""
    # each task keeps its smallest hashes, so the stored table has 2 * most rows a task at most
    found = docs.select(F.col(text_col).alias("_text")).mapInArrow(
        _windows(seed, most), "has int, rank bigint, piece string, tags binary").distinct().transform(cut_lineage)
    drawn = [found.where(F.col("has") == has).orderBy("rank", "piece").limit(most) for has in (0, 1)]
    return drawn[0].unionByName(drawn[1])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["has"], r["rank"], r["piece"], r["tags"]) for b in batches for r in b.to_pylist())
    model = train([(p, np.frombuffer(t, np.int8).astype(np.int64)) for _, _, p, t in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def fit(docs: DataFrame, text_col: str = "text") -> Tagger | None:
    """Train on the table's labelled windows: one task, as the sample is bounded."""
    windows = labelled_windows(docs, text_col).coalesce(1)
    models = windows.mapInArrow(_train_task, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


def rewritten(kind: int, span: str, rng: np.random.Generator) -> str:
    """A labelled span as it may also be written."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == 0:
        return span.replace("@", pick(" @ ", "(at)", " (at) ", "[at]"), 1)
    if kind == 1:
        return span.replace(".", pick(" . ", ". "))
    digits = "".join(_DIGIT.findall(span))
    if kind == 2:
        return pick(".", "  ", "/", " - ").join(digits[i:i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:] if len(digits) >= 10 else digits
    return pick("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00 {} {} {}").format(local[:-7], local[-7:-4], local[-4:])


def _spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a tag path; an I that doesn't continue its kind opens a span."""
    out, i = [], 0
    while i < len(tags):
        if tags[i]:
            kind, j = (tags[i] - 1) // 2, i + 1
            while j < len(tags) and tags[j] == 2 + 2 * kind:
                j += 1
            out.append((int(kind), i, j))
            i = j
        else:
            i += 1
    return out


def training_set(windows: list[tuple[str, np.ndarray]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags: each window, and each window with whole spans rewritten."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for piece, tags in windows:
        x.append(symbols(piece, WINDOW))
        y.append(tags)
        spans = [s for s in _spans_of(tags) if s[2] < WINDOW and tags[s[1]] % 2]
        if not spans:
            continue
        text, new, at = "", [], 0
        for kind, a, z in spans:
            text += piece[at:a]
            span = rewritten(kind, piece[a:z], rng)
            new.append((kind, len(text), len(text) + len(span)))
            text, at = text + span, z
        text += piece[at:]
        x.append(symbols(text, WINDOW))
        y.append(tag_window(new, 0))
    return np.array(x), np.array(y)


def train(windows: list[tuple[str, np.ndarray]], epochs: int = EPOCHS) -> Tagger | None:
    """A tagger from labelled windows; None without any labelled span."""
    if not any(t.any() for _, t in windows):
        return None
    return Tagger(TAGS).fit(*training_set(windows), epochs=epochs)


# ------------------------------------------------------------------ decoding
_ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]")


def reconcile(found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """(kind, start, end, confidence, cut by a window's edge) of all windows of
    a document -> non-overlapping spans of greatest summed confidence."""
    merged: list[list] = []
    for kind, a, z, sure, cut in sorted(found, key=lambda s: (s[0], s[1], s[2])):
        last = merged[-1] if merged else None
        if last and last[0] == kind and a < last[2] and (cut or last[4] or (a, z) == (last[1], last[2])):
            whole = max(last[2] - last[1], z - a)
            last[4] = last[4] and cut if whole > 0 else cut
            last[2], last[3] = max(last[2], z), max(last[3], sure)
        else:
            merged.append([kind, a, z, sure, cut])
    spans = sorted(merged, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best = [0.0]
    take = []
    for k, (_, a, z, sure, _) in enumerate(spans):
        before = bisect.bisect_right(ends, a, 0, k)
        with_it = best[before] + sure * (z - a)
        take.append((with_it > best[-1], before))
        best.append(max(best[-1], with_it))
    out, k = [], len(spans)
    while k:
        yes, before = take[k - 1]
        if yes:
            out.append(tuple(spans[k - 1][:3]))
            k = before
        else:
            k -= 1
    return out[::-1]


def valid(kind: int, span: str) -> bool:
    """The check of a kind, whatever the separators."""
    digits = "".join(_DIGIT.findall(span))
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\x20?(@|[(\[]at[)\]])\x20?[A-Za-z0-9-]+(\x20?\.\x20?[A-Za-z0-9-]+)+", span))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\x20?\.\x20?[0-9]{1,3}){3}", span)) and all(
            _octet(p.strip()) for p in span.split("."))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9\x20./-]+[0-9]", span)) and 16 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"(00\x20)?\(?[0-9]{2,4}[)\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{4}", span)) and 9 <= len(digits) <= 15


def tagged(tagger: Tagger | None, texts: list[str], bases: list[list]) -> list[list[tuple[int, int, int]]]:
    """The added spans of each text."""
    jobs = [(k, s) for k, t in enumerate(texts) if tagger is not None and t and _ANCHOR.search(t)
            for s in window_starts(t, _ANCHOR)]
    found: list[list] = [[] for _ in texts]
    for lo in range(0, len(jobs), DECODE_ROWS):
        some = jobs[lo:lo + DECODE_ROWS]
        tags, sure = tagger.decode(np.array([symbols(texts[k][s:s + WINDOW], WINDOW) for k, s in some]))
        for (k, s), row, p in zip(some, tags, sure):
            if not row.any():
                continue
            n = len(texts[k])
            for kind, a, z in _spans_of(row):
                z = min(z, n - s)
                if a < z:
                    cut = (a == 0 and s > 0) or (z == WINDOW and s + z < n)
                    found[k].append((kind, s + a, s + z, float(p[a:z].mean()), cut))
    out = []
    for text, spans, base in zip(texts, found, bases):
        sure = [s for s in spans if s[3] >= SURE]
        out.append([(k, a, z) for k, a, z in reconcile(sure) if valid(k, text[a:z])
                    and not any(x < z and a < y for _, x, y in base)])
    return out


def _find(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
        for b in batches:
            ids, texts = b.column("_id"), [t or "" for t in b.column("_text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = tagged(shared.value, texts, bases)
            every = [sorted([(*s, True) for s in x] + [(*s, False) for s in y]) for x, y in zip(bases, added)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([[{"kind": k, "start": a, "stop": z, "base": o} for k, a, z, o in row] for row in every], kind)],
                ["_id", "spans"])

    return rows


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tagger: Tagger | None = None) -> DataFrame:
    """(id, spans): every row's spans (kind number, start, stop, base), code points.

    Without a ``tagger`` one is trained on the table's own base spans.
    """
    if tagger is None:
        tagger = fit(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # some thousand numbers
    named = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return named.mapInArrow(
        _find(shared), "_id bigint, spans array<struct<kind:int,start:int,stop:int,base:boolean>>").select(
        F.col("_id").alias(id_col), "spans")


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, spans) -> the digest columns of the query."""
    for b in batches:
        rows = []
        for spans in b.column("spans").to_pylist():
            text = lambda some: ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['stop']}" for s in some)
            base = [s for s in spans if s["base"]]
            n = [sum(s["kind"] == k for s in base) for k in range(len(KINDS))]
            rows.append((*n, hashlib.sha256(text(base).encode()).hexdigest(), text(spans), len(spans) - len(base)))
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                         [x.split()[0] for x in DIGEST.split(", ")])


DIGEST = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
          "spans string, n_added bigint")
