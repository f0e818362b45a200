"""Personal data: spans by strict rules, and more by candidate generation and gradient boosting.

Base spans are the leftmost matches of four fixed patterns that pass a check (address parts, Luhn, number of digits). They are
found in linear time: each pattern starts only where a run of its characters does.

Beyond them, generators of high recall propose spans that may overlap: addresses whose @ or dots are spelled out or bracketed,
and windows of neighbouring digit groups under any separators. Boosted trees score each candidate by its format (lengths, groups,
separators, Luhn) and context (characters and cue words around it); a score calibrated on held-back candidates selects, for each
kind, what is added. Added spans overlap neither each other nor a base span; of overlapping ones the higher score wins, then
the earlier, then the longer.

No table says what is personal data, so the trees learn from the base rules: in every document the candidates that are a base
span are positive, those that cut or overrun one and all others negative; every base span is also rewritten the way people
disguise such data (`disguised`), in its place, and found again by the generators. The threshold of a kind is the least score that
at most `FALSE_RATE` of the held-back candidates away from base spans reach; with too few examples of a kind nothing is added to it.

The model is fitted on all candidates of all documents, copies with the same text around them once; a fifth, by that text, is held
back for calibration and threshold. Examples whose features are alike are one row with their number. Each level of a tree is one
pass over these rows that adds up gradients by kind, node, feature and bin, so `TREES` x `DEPTH` passes in all; only such sums,
of a fixed number, come to the driver. They are whole numbers, so that neither order nor partitions change the model, which is
some kB and broadcast.

Defined results: null counts as empty and has no spans; positions are code points; ids may be null or repeat, each row comes
back; no documents give no rows; a long text is one row of work in one task, linear in its length; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import drop_table, read, write_table

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, RATE, SMOOTH, BINS = 50, 4, 0.25, 1.0, 32
FALSE_RATE, LEAST_SCORE, LEAST_EXAMPLES = 0.001, 0.5, 20
HELD = 5  # one in so many examples is held back
STEPS, MOST_LOGIT = 256, 100  # held-back logits are counted in steps of 1 / STEPS, up to MOST_LOGIT
UNIT = 2.0**26  # what gradients are whole multiples of when they are added up
SCORED_ROWS = 4_096  # candidates scored at a time
TASK_ROWS = 50_000  # examples that differ, for each task of a pass of fitting

Span = tuple[int, int, int]  # kind, start, end

# The characters and patterns of the base rules.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (ord(c) - 48) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by kind and start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
        free = found.end() if found else at + 1  # no other start reaches this @
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(map(_small_part, m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# -- candidates ------------------------------------------------------------------------------------------------------------

_AT = re.compile(r" ?[(\[{] ?(?:at|AT) ?[)\]}] ?| (?:at|AT) | ?[@＠] ?")
_DOT = r"(?:\.| ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?| (?:dot|DOT) )"
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_NEXT_LABEL = re.compile(_DOT + r"[A-Za-z0-9-]{1,63}")
_GROUP = re.compile(r"[0-9]+")
_GAP = frozenset(" ().-/[]+")
_MOST_GAP, _MOST_GROUPS, _MOST_DIGITS, _LOCAL_CHARS, _MOST_LABELS = 3, 7, 19, 64, 8
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _addresses(text: str) -> Iterator[Span]:
    for m in _AT.finditer(text):
        before = text[max(0, m.start() - _LOCAL_CHARS) : m.start()]
        start = m.start() - len(before) + len(before.rstrip(_LOCAL))
        label = _LABEL.match(text, m.end()) if start < m.start() else None
        for _ in range(_MOST_LABELS if label else 0):
            label = _NEXT_LABEL.match(text, label.end())
            if not label:
                break
            yield 0, start, label.end()


def _chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Digit groups that only separators part, three at most in a gap; runs of letters and digits give none."""
    chain: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        a, b = m.span()
        if a and text[a - 1] in _LETTERS or b < len(text) and text[b] in _LETTERS:
            if chain:
                yield chain
            chain = []
            continue
        if chain and not (a - chain[-1][1] <= _MOST_GAP and _GAP.issuperset(text[chain[-1][1] : a])):
            yield chain
            chain = []
        chain.append((a, b))
    if chain:
        yield chain


def _numbers(text: str) -> Iterator[Span]:
    for chain in _chains(text):
        for i, (a, _) in enumerate(chain):
            digits = 0
            for j in range(i, min(i + _MOST_GROUPS, len(chain))):
                end = chain[j][1]
                digits += end - chain[j][0]
                if digits > _MOST_DIGITS:
                    break
                if j - i == 3 and digits <= 12 and all("." in text[chain[k][1] : chain[k + 1][0]] for k in range(i, j)):
                    yield 1, a, end
                if digits >= 13:
                    yield 2, a, end
                if 7 <= digits <= 15:
                    head = a
                    while head and a - head < 2 and text[head - 1] in "+(":
                        head -= 1
                    yield 3, head, end


def candidates(text: str) -> Iterator[Span]:
    yield from _addresses(text)
    yield from _numbers(text)


# Cue words before a span, by kind, and those of numbers that are something else.
_CUES = [
    re.compile(p, re.I)
    for p in (
        r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt|schreib)",
        r"\b(?:ip|host|server|address|addr|gateway|dns|proxy|adresse|direcci)",
        r"\b(?:card|visa|master|amex|credit|debit|payment|pan|carte|karte|tarjeta)",
        r"\b(?:phone|tel|call|fax|mobile|cell|whatsapp|sms|telefon|handy|tél|appel|llam|móvil)",
        r"\b(?:version|v|ver|isbn|issn|doi|id|no|nr|order|invoice|section|chapter|fig|page|token|key|sha|md5|date|eur|usd)\b\W*$",
    )
]
_CONTEXT = 32


def _char_class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate; of each feature there are some hundred values at most, as candidates are short."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - _CONTEXT) : a], text[b : b + 3]
    groups = _GROUP.findall(s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    letters = sum(map(str.isalpha, s))
    lowered = s.lower()
    labels = re.split(r"[^A-Za-z0-9]+", s)
    pairs = " ().-/"
    gaps = _NOT_DIGITS.findall(s.strip("+("))
    found = [
        len(s), len(digits), letters, s.count(" "), s.count("."), s.count("-"), s.count("(") + s.count(")"), s.count("[") + s.count("]"), s.count("/"),
        len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(set(digits)), len(set(gaps)),
        s[:1] == "+" or before[-1:] == "+", digits[:1] == "0", "@" in s or "＠" in s, " at " in lowered or "at)" in lowered or "at]" in lowered, " dot " in lowered or "dot)" in lowered or "dot]" in lowered,
        len(labels[-1]), labels[-1].isalpha(), kind in (2, 3) and luhn(digits), kind == 1 and all(map(_small_part, groups)), round(sum(map(str.isupper, s)) / max(1, letters), 2),
        _char_class(before[-1:]), _char_class(after[:1]), before[-1:] in ("=", '"', "'", "#", "$", "€"),
        after[:1] in pairs and after[1:2].isdigit() or after[:1].isdigit(), before[-1:] in pairs and before[-2:-1].isdigit() or before[-1:].isdigit(),
        *(bool(cue.search(before)) for cue in _CUES),
    ]
    return [float(x) for x in found]


# -- boosted trees ---------------------------------------------------------------------------------------------------------


@dataclass
class BoostedTrees:
    """Trees of one depth; node k has the children 2k + 1 and 2k + 2, and a row goes right where its feature exceeds the cut."""

    prior: float
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    values: np.ndarray  # trees x leaves

    def nodes(self, t: int, x: np.ndarray, levels: int) -> np.ndarray:
        """Where rows are in tree t after so many levels, counted from 0 within the last one."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(levels):
            node = 2 * node + 1 + (x[rows, self.features[t, node]] > self.cuts[t, node])
        return node - (2**levels - 1)

    def logits(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        """By the first `trees` trees, or all."""
        out, depth = np.full(len(x), self.prior), self.values.shape[1].bit_length() - 1
        for t in range(len(self.features) if trees is None else trees):
            out += self.values[t, self.nodes(t, x, depth)]
        return out


def unfitted(negative: float, positive: float, trees: int = TREES, depth: int = DEPTH) -> BoostedTrees:
    """Trees without splits, and the prior of so many examples."""
    share, inner = np.clip(positive / (negative + positive), 1e-6, 1 - 1e-6), 2**depth - 1
    return BoostedTrees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))


def cut_points(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where a feature is cut into bins, from its values in order and their counts by label (values x 2): between all values if
    they are few, else at quantiles to which each label contributes the same."""
    if len(values) <= BINS:
        return values[:-1]
    mass = (counts / np.maximum(counts.sum(axis=0), 1)).sum(axis=1).cumsum()
    return np.unique(values[np.searchsorted(mass, np.linspace(0, mass[-1], BINS + 1)[1:-1])])


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of all features: code > k where x > edges[k]."""
    return np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)


def gradient_sums(model: BoostedTrees, t: int, level: int, codes: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradients and curvatures of the logistic loss, in units, by node of a level of tree t, feature and code."""
    p = 1 / (1 + np.exp(-model.logits(codes, t)))
    cells = codes.shape[1] * BINS
    place = (model.nodes(t, codes, level)[:, None] * cells + np.arange(0, cells, BINS) + codes).ravel()
    sums = (weights * np.rint(s * UNIT) for s in (p - y, p * (1 - p)))
    return np.stack([np.rint(np.bincount(place, np.repeat(s, codes.shape[1]), 2**level * cells)) for s in sums]).astype(np.int64)


def split_level(model: BoostedTrees, t: int, level: int, sums: np.ndarray, edges: list[np.ndarray]) -> None:
    """Give the nodes of a level their best cuts, as codes, and after the last level the leaves their values."""
    first, width = 2**level - 1, 2**level
    g, h = sums.reshape(2, width, len(edges), BINS).cumsum(axis=3) / UNIT
    whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
    gain = g**2 / (h + SMOOTH) + (whole_g - g) ** 2 / (whole_h - h + SMOOTH) - whole_g**2 / (whole_h + SMOOTH)
    best = gain.reshape(width, -1).argmax(axis=1)
    for k in range(width):
        f, code = divmod(int(best[k]), BINS)
        if gain[k, f, code] > 1e-9 and code < len(edges[f]):
            model.features[t, first + k], model.cuts[t, first + k] = f, code
        else:
            f, code = 0, BINS - 1  # all go left
        if 2 * width == model.values.shape[1]:
            left_g, left_h = g[k, f, code], h[k, f, code]
            model.values[t, 2 * k] = -RATE * left_g / (left_h + SMOOTH)
            model.values[t, 2 * k + 1] = -RATE * (whole_g[k, f, 0] - left_g) / (whole_h[k, f, 0] - left_h + SMOOTH)


def boost(models: dict[int, BoostedTrees], edges: dict[int, list[np.ndarray]], sums: Callable[[int, int], dict[int, np.ndarray]], trees: int = TREES, depth: int = DEPTH) -> dict[int, BoostedTrees]:
    """Second-order boosting of some models side by side; sums(t, level) are the gradients of all examples, by model."""
    for t in range(trees):
        for level in range(depth):
            for k, found in sums(t, level).items():
                split_level(models[k], t, level, found, edges[k])
    out = {}
    for k, m in models.items():
        cuts = m.cuts.copy()
        for at in np.argwhere(np.isfinite(cuts)):
            cuts[tuple(at)] = edges[k][m.features[tuple(at)]][int(cuts[tuple(at)])]
        out[k] = BoostedTrees(m.prior, m.features, cuts, m.values)
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, weights: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> BoostedTrees:
    """The same boosting of examples in memory."""
    edges = []
    for column in x.T:
        values, place = np.unique(column, return_inverse=True)
        edges.append(cut_points(values, np.stack([np.bincount(place, weights * (y == k), len(values)) for k in (0, 1)], axis=1)))
    codes, model = coded(x, edges), unfitted((weights * (1 - y)).sum(), (weights * y).sum(), trees, depth)
    return boost({0: model}, {0: edges}, lambda t, level: {0: gradient_sums(model, t, level, codes, y, weights)}, trees, depth)[0]


def _platt(logits: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make logits probabilities, by Newton steps with a small ridge towards (1, 0)."""
    ab, design = np.array([1.0, 0.0]), np.stack([logits, np.ones(len(logits))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
        slope = design.T @ (weights * (p - y)) + 0.1 * (ab - [1.0, 0.0])
        curve = (design * (weights * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(max(ab[0], 1e-3)), float(ab[1])


@dataclass
class PiiModel:
    """For each kind its trees, calibration and threshold; kinds without enough examples are absent."""

    kinds: dict[int, tuple[BoostedTrees, tuple[float, float], float]] = field(default_factory=dict)

    def scores(self, kind: int, x: np.ndarray) -> np.ndarray:
        trees, (slope, shift), _ = self.kinds[kind]
        return 1 / (1 + np.exp(-np.clip(slope * trees.logits(x) + shift, -30, 30)))

    def added(self, text: str, base: list[Span]) -> list[tuple[int, int, int, float]]:
        """The candidates that are selected, by kind and start."""
        taken = _merged(base)
        chosen: list[tuple[float, int, int, int]] = []
        block: dict[int, list[Span]] = {kind: [] for kind in self.kinds}

        def score(kind: int) -> None:
            spans, threshold = block[kind], self.kinds[kind][2]
            if spans:
                p = self.scores(kind, np.array([describe(text, s) for s in spans], np.float64))
                chosen.extend((-float(p[k]), spans[k][1], -spans[k][2], kind) for k in np.flatnonzero(p >= threshold))
                block[kind] = []

        for span in candidates(text):
            if span[0] in block and not _meets(taken, span[1], span[2]):
                block[span[0]].append(span)
                if len(block[span[0]]) >= SCORED_ROWS:
                    score(span[0])
        for kind in self.kinds:
            score(kind)
        out = []
        for p, start, end, kind in sorted(chosen):
            if not _meets(taken, start, -end):
                taken.insert(bisect_left(taken, (start, -end)), (start, -end))
                out.append((kind, start, -end, -p))
        return sorted(out)


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """What spans of any kind cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _meets(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps one of the intervals `taken`, which lie apart."""
    k = bisect_left(taken, (b, b))
    return k > 0 and taken[k - 1][1] > a


# -- learning --------------------------------------------------------------------------------------------------------------


def disguised(kind: int, span: str, variant: int) -> str:
    """The text of a base span, written as people do who hide it from the base rules."""
    if kind == 0:
        name, _, domain = span.partition("@")
        at = (" at ", "(at)", " [at] ", " @ ", " (at) ", "＠")[variant % 6]
        return name + at + domain.replace(".", (" dot ", ".", "[.]", "(dot)", " [dot] ")[variant // 6 % 5])
    if kind == 1:
        return span.replace(".", ("[.]", " . ", "(.)", ". ")[variant % 4])
    digits = _NOT_DIGITS.sub("", span)
    if kind == 2:
        cut = (".", " - ", "/", "  ")[variant % 4]
        return cut.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    rest = span.lstrip("+")
    return (rest, f"00{rest}", f"({rest[: len(rest) // 4]}) {rest[len(rest) // 4 :]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}")[variant % 4]


def _seen(text: str, span: Span) -> int:
    """A number for a candidate with the text around it: examples from copies of a text share it."""
    around = text[max(0, span[1] - _CONTEXT) : span[2] + 3].encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(around, digest_size=8).digest(), "little", signed=True)


def examples(text: str) -> Iterator[tuple[int, int, bool, int, list[float]]]:
    """Kind, label, whether it lies away from base spans, a number for its text, and features of every candidate, disguised base
    spans among them."""
    base = base_spans(text)
    own, taken = set(base), _merged(base)
    for span in candidates(text):
        yield span[0], int(span in own), not _meets(taken, span[1], span[2]), _seen(text, span), describe(text, span)
    for kind, a, b in base:
        written = disguised(kind, text[a:b], zlib.crc32(text[a:b].encode("utf-8", "replace")))
        before = text[max(0, a - 2 * _CONTEXT) : a]
        around = before + written + text[b : b + _CONTEXT]
        start, end = len(before), len(before) + len(written)
        for span in candidates(around):
            if span[0] == kind and span[1] < end and span[2] > start:
                yield kind, int(span[1:] == (start, end)), True, _seen(around, span), describe(around, span)


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.float64())]
    for some in batched((e for batch in batches for text in batch.column(0) for e in examples(text.as_py() or "")), SCORED_ROWS):
        columns = [pa.array(values, kind) for values, kind in zip(zip(*some, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "y", "away", "seen", "x"])


def _numbers_of(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for name in names]


def _codes_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("codes")).to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _with_codes(edges: dict[int, list[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """kind, y, away, held, x, n with codes in place of x; kinds without edges go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (kinds,) = _numbers_of(batch, "kind")
            for kind in edges:
                part = batch.filter(pa.array(kinds == kind))
                if part.num_rows:
                    x = part.column(4).flatten().to_numpy().reshape(part.num_rows, -1)
                    codes = pa.array([row.tobytes() for row in coded(x, edges[kind])], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], codes, part.column(5)], ["kind", "y", "away", "held", "codes", "n"])

    return run


def _blocks(rows: Iterator[Row]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """kind, codes, y, n of many rows of a kind."""
    for some in batched(rows, SCORED_ROWS):
        for kind in sorted({r.kind for r in some}):
            own = [r for r in some if r.kind == kind]
            codes = np.frombuffer(b"".join(r.codes for r in own), np.uint8).reshape(len(own), -1)
            yield kind, codes, np.array([r.y for r in own]), np.array([r.n for r in own])


def _summed(models: dict[int, BoostedTrees], t: int, level: int) -> Callable[[Iterator[tuple]], Iterator[dict[int, np.ndarray]]]:
    """The gradient sums of a task's blocks, by kind."""

    def run(blocks: Iterator[tuple]) -> Iterator[dict[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        for kind, codes, y, n in blocks:
            sums[kind] = sums.get(kind, 0) + gradient_sums(models[kind], t, level, codes, y, n)
        yield sums

    return run


def _both(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {kind: a.get(kind, 0) + b.get(kind, 0) for kind in a | b}


def _stepped(models: dict[int, BoostedTrees]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their logits in steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (kinds,), codes = _numbers_of(batch, "kind"), _codes_of(batch)
            step = np.zeros(len(kinds), np.int32)
            for kind in np.unique(kinds).tolist():
                step[kinds == kind] = np.floor(np.clip(models[kind].logits(codes[kinds == kind]), -MOST_LOGIT, MOST_LOGIT) * STEPS)
            columns = [batch.column(batch.schema.get_field_index(name)) for name in ("kind", "y", "away", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(step)], ["kind", "y", "away", "n", "step"])

    return run


def calibrated(step: np.ndarray, y: np.ndarray, away: np.ndarray, n: np.ndarray) -> tuple[tuple[float, float], float]:
    """Calibration and threshold from the numbers of held-back examples by step of their logits."""
    slope, shift = _platt((step + 0.5) / STEPS, y, n)
    order = np.argsort(-step, kind="stable")
    wrong = np.where((y == 0) & away, n, 0)[order]
    if not wrong.sum():
        return (slope, shift), LEAST_SCORE
    # the first step at which too many pass: only what lies above it is let through
    limit = (step[order][(wrong.cumsum() > FALSE_RATE * wrong.sum()).argmax()] + 1) / STEPS
    score = 1 / (1 + np.exp(-np.clip(slope * limit + shift, -30, 30)))
    return (slope, shift), float(max(LEAST_SCORE, np.nextafter(score, 1.0)))


def fit_pii_model(docs: DataFrame, text_col: str = "text") -> PiiModel:
    """Fit on all candidates of all documents."""
    found = docs.select(F.col(text_col)).mapInArrow(_example_rows, "kind int, y int, away boolean, seen long, x array<double>").distinct()  # one of all copies
    held = F.pmod(F.col("seen"), F.lit(HELD)) == HELD - 1
    alike = write_table(found.groupBy("kind", "y", (held & F.col("away")).alias("away"), held.alias("held"), "x").agg(F.count("*").alias("n")), "pii-examples")
    totals = {kind: [0, 0] for kind in range(len(KINDS))}
    fitted_on = {kind: [0, 0] for kind in range(len(KINDS))}
    for r in alike.groupBy("kind", "y").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("held"), F.col("n")).otherwise(0)).alias("fit")).collect():
        totals[r.kind][r.y], fitted_on[r.kind][r.y] = r.n, r.fit
    models = {kind: unfitted(*fitted_on[kind]) for kind, both in totals.items() if min(both) >= LEAST_EXAMPLES and sum(fitted_on[kind])}
    if not models:
        drop_table(alike)
        return PiiModel()

    # bins of the features: their values are few whatever the documents, so their counts come to the driver
    values = alike.where(~F.col("held")).select("kind", "y", "n", F.posexplode("x").alias("feature", "value"))
    counts: dict[tuple[int, int], dict[float, list[int]]] = {}
    for r in values.groupBy("kind", "feature", "value").agg(*(F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1))).collect():
        counts.setdefault((r.kind, r.feature), {})[r.value] = [r.n0, r.n1]
    edges = {kind: [cut_points(np.array(sorted(c)), np.array([c[v] for v in sorted(c)])) for _, c in sorted((f, c) for (k, f), c in counts.items() if k == kind)] for kind in models}
    same = alike.mapInArrow(_with_codes(edges), "kind int, y int, away boolean, held boolean, codes binary, n long")
    binned = write_table(same.groupBy("kind", "y", "away", "held", "codes").agg(F.sum("n").alias("n")), "pii-bins")
    drop_table(alike)

    # many passes over few rows: as many tasks as the rows need, however many files they came in
    tasks = 1 + binned.count() // TASK_ROWS
    blocks = binned.where(~F.col("held")).select("kind", "y", "codes", "n").coalesce(tasks).rdd.mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK)
    on_values = boost(models, edges, lambda t, level: blocks.mapPartitions(_summed(models, t, level)).treeReduce(_both))
    blocks.unpersist()
    steps = binned.where("held").mapInArrow(_stepped(models), "kind int, y int, away boolean, n long, step int")
    rows = sorted(steps.groupBy("kind", "y", "away", "step").agg(F.sum("n").alias("n")).collect())
    drop_table(binned)
    out = PiiModel()
    for kind, trees in on_values.items():
        own = [r for r in rows if r.kind == kind]
        out.kinds[kind] = (trees, *calibrated(*(np.array([r[name] for r in own]) for name in ("step", "y", "away", "n"))))
    return out


# -- search ----------------------------------------------------------------------------------------------------------------

SPANS = "array<struct<kind: string, start: long, end: long, score: double, base: boolean>>"


def find_pii(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """doc_id and spans for every row, by kind as in KINDS and start; with `redact` also the text with its spans replaced."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
        for batch in batches:
            spans, texts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                every = sorted([*((k, a, b, 1.0, True) for k, a, b in base), *((*s, False) for s in handle.value.added(text, base))])
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "score": p, "base": strict} for k, a, b, p, strict in every])
                if redact:
                    texts.append(redacted(text, [s[:3] for s in every]))
            columns = [batch.column(0), pa.array(spans, pa.list_(struct)), *([pa.array(texts, pa.string())] if redact else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "redacted"][: len(columns)])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, spans {SPANS}" + (", redacted string" if redact else ""))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with `[kind]` for every span; where spans overlap, one mark of the first covers them."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind]}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def spans_text(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; n_email to n_phone count base spans, n_added the others."""
    docs = read(spark, sf_dir, "documents")
    found = find_pii(docs, fit_pii_model(docs))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *map(number, KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), added)
