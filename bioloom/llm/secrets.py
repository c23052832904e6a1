"""Secrets in texts: three rules, and Markov models of characters for what the rules don't know.

Rules find assignments to names like ``token``, access keys and long hexadecimal strings. What they find are labelled samples
of random strings; all other strings of the same alphabet are labelled samples of ordinary identifiers. Each distinct string
counts once, wherever and however often it stands, so copies teach nothing twice. Over both classes next characters are
counted by the two before (all strings of the corpus; tasks add up, one shuffle of at most 2 x 70**3 sums), and a candidate
is a secret if its log-likelihood ratio of random against ordinary reaches ``LEAST_RATIO``. A candidate is one of the strings
that were taken for ordinary; what it added to the counts is taken off where it is judged, or it would vouch for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bioloom.llm.blocks import apart, text_blocks
from bioloom.session import stored

#: Fixed by the contract: rules, and the least lengths of what they match.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = b"0123456789abcdef"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")
MODEL = "model"

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Symbols of a model: the alphabet, a dot (inside assigned values only) and what stands before a string.
SYMBOLS = len(ALPHABET) + 2
START = SYMBOLS - 1
#: Strings of fewer characters teach nothing about identifiers.
IDENTIFIERS = re.compile(rb"[A-Za-z0-9+/_=-]{4,}")
#: A candidate has at least so many characters and at least this log-likelihood ratio, in nats.
LEAST_LENGTH, LEAST_RATIO = 16, 20.0
#: Weight of the shorter context's estimate, in counts.
BACKOFF = 4.0
#: Share of a random and of an ordinary string's characters that may be any, as no sample holds all kinds of either.
ANYTHING, UNUSUAL = 0.5, 0.05
#: One string in so many is left out of training where accuracy is measured.
HELD_OUT = 10

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _table(members: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


def _codes() -> np.ndarray:
    codes = np.full(256, START, np.int32)
    codes[list(ALPHABET + b".")] = np.arange(len(ALPHABET) + 1)
    return codes


def runs(buf: np.ndarray, bounds: np.ndarray, members: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of ``members`` inside each text, of ``least`` bytes or more."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = members[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    some = inside[begin] & (end - begin >= least)
    return begin[some], end[some]


def rule_spans(raw: bytes, hexes: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """``start, rank of the kind, end, start of the secret part`` of what the rules find, in bytes."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(raw.lower()) if m.end() - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    if hexes is None:
        begin, end = runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _table(HEX), LEAST_HEX)
        hexes = list(zip(begin.tolist(), end.tolist(), strict=True))
    found += [(a, 2, b, a) for a, b in hexes]
    return sorted(found)


def labelled_strings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``string, secret``: each distinct string that a rule takes for a secret, and each distinct other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            secret: set[bytes] = set()
            other: set[bytes] = set()
            for value in batch.column(0):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                spans = rule_spans(raw)
                if spans:
                    secret.update(raw[part:end] for _, _, end, part in spans)
                    left = bytearray(raw)
                    for start, _, end, _ in spans:
                        left[start:end] = b" " * (end - start)
                    raw = bytes(left)
                other.update(IDENTIFIERS.findall(raw))
            strings = pa.array([*secret, *other], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([strings, pa.array([True] * len(secret) + [False] * len(other))], ["string", "secret"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "string string, secret boolean").distinct()


def _transitions(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each character of the joined strings, the cell of itself after the two before it."""
    codes = _codes()[buf].astype(np.int64)
    one, two = np.full(len(codes), START), np.full(len(codes), START)
    one[1:], two[2:] = codes[:-1], codes[:-2]
    starts = bounds[:-1][np.diff(bounds) > 0]
    one[starts] = two[starts] = START
    second = starts + 1
    two[second[second < len(codes)]] = START
    return (two * SYMBOLS + one) * SYMBOLS + codes


def transition_counts(strings: DataFrame) -> np.ndarray:
    """How often each character follows each two, for ordinary (0) and random (1) strings of ``string, secret``."""
    size = SYMBOLS**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            secret = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for b in text_blocks(batch.column(0)):
                label = np.repeat(secret[b.first : b.last], np.diff(b.bounds))
                total += np.bincount(_transitions(b.buf, b.bounds) + label * size, minlength=2 * size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    summed = strings.select("string", "secret").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * size)
    counts[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
    return counts.reshape(2, SYMBOLS, SYMBOLS, SYMBOLS)


class Model(NamedTuple):
    """Log probability of each character after each two in random strings, and the same as counts in ordinary ones."""

    random: np.ndarray
    ordinary: np.ndarray


def _estimate(n: list[np.ndarray], totals: list[np.ndarray]) -> np.ndarray:
    """Probabilities from the counts of one, two and three characters, each backing off to the one before and that to any symbol."""
    p = 1 / SYMBOLS
    for count, total in zip(n, totals, strict=True):
        p = (count + BACKOFF * p) / (total + BACKOFF)
    return p


def model_of(counts: np.ndarray) -> Model:
    """The models of both classes' counts. Without samples all characters are equally likely."""
    n = counts[1]
    found = _estimate([n.sum((0, 1)), n.sum(0), n], [n.sum(), n.sum((0, 2))[:, None], n.sum(2)[..., None]])
    return Model(np.log((1 - ANYTHING) * found + ANYTHING / SYMBOLS), counts[0])


def ratios(buf: np.ndarray, bounds: np.ndarray, model: Model, taught: bool) -> np.ndarray:
    """The log-likelihood ratio of each string, random against ordinary; ``taught`` if they are among the ordinary samples."""
    cells = _transitions(buf, bounds)
    one, two, three = cells % SYMBOLS, cells % SYMBOLS**2, cells
    n = model.ordinary
    found = [n.sum((0, 1))[one], n.sum(0).ravel()[two], n.ravel()[three]]
    totals = [n.sum(), n.sum((0, 2))[two // SYMBOLS], n.sum(2).ravel()[three // SYMBOLS]]
    string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if taught:

        def own(keys: np.ndarray) -> np.ndarray:
            _, index, times = np.unique(string * SYMBOLS**3 + keys, return_inverse=True, return_counts=True)
            return times[index]

        # A stretch that a rule's span cuts was no sample as it is; it is no candidate either, so its figures don't matter.
        found = [np.maximum(x - own(k), 0) for x, k in zip(found, (one, two, three), strict=True)]
        less = (np.diff(bounds)[string], own(two // SYMBOLS), own(three // SYMBOLS))
        totals = [np.maximum(x - y, 0) for x, y in zip(totals, less, strict=True)]
    ordinary = np.log((1 - UNUSUAL) * _estimate(found, totals) + UNUSUAL / SYMBOLS)
    # Each string's sum is its own, whatever stands beside it.
    return np.bincount(string, model.random.ravel()[three] - ordinary, len(bounds) - 1)


def learn(docs: DataFrame, text: str = "text") -> Model:
    """The models, learned from all texts as the rules label their strings."""
    return model_of(transition_counts(labelled_strings(docs, text)))


def string_scores(strings: DataFrame, model: Model) -> DataFrame:
    """``string, secret`` of strings that the model wasn't taught by, with ``score``, their ratio; empty strings score zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ratios(b.buf, b.bounds, model, False) for b in text_blocks(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *found]))], ["string", "secret", "score"])

    return strings.select("string", "secret").mapInArrow(run, "string string, secret boolean, score double")


def held_out_accuracy(docs: DataFrame, text: str = "text") -> dict[str, tuple[int, int]]:
    """Of the strings left out of training that are long enough to be candidates: how many of each label there are and how many
    are judged as labelled."""
    strings = stored(labelled_strings(docs, text), "strings")
    out = F.pmod(F.crc32(F.col("string").cast("binary")), F.lit(HELD_OUT)) == 0
    model = model_of(transition_counts(strings.where(~out)))
    right = ((F.col("score") >= LEAST_RATIO) == F.col("secret")).cast("long")
    scored = string_scores(strings.where(out & (F.length("string") >= LEAST_LENGTH)), model)
    return {("random" if r["secret"] else "ordinary"): (r["n"], r["right"]) for r in scored.groupBy("secret").agg(F.count("*").alias("n"), F.sum(right).alias("right")).collect()}


def _points(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Byte places as numbers of code points."""
    following = np.flatnonzero((raw & 0xC0) == 0x80)
    return places - np.searchsorted(following, places, "left")


def find_secrets(docs: DataFrame, model: Model, text: str = "text", least_length: int = LEAST_LENGTH, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``docs`` without ``text``, with ``spans``: kind, start and end (exclusive) in code points, by start, then kind (rules as
    listed, the model last).

    A span of the model is a longest stretch of the alphabet, of ``least_length`` or more, that no rule's span touches and whose
    ratio is ``least_ratio`` or more. Null and empty texts have no spans; rows and their other columns stay as they are, repeated
    rows too; a given column ``spans`` is replaced. An empty table gives no rows. A text is never cut.
    """
    names = [c for c in docs.columns if c not in (text, "spans")]
    own = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("text_ of secrets"))
    named = apart(own, "text_ of secrets")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in named.schema.fields[:-1])
    listed = (*BASE_KINDS, MODEL)
    spans_kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    hexes, members = _table(HEX), _table(ALPHABET)

    def of_block(buf: np.ndarray, bounds: np.ndarray) -> Iterator[list[dict]]:
        hex_begin, hex_end = runs(buf, bounds, hexes, LEAST_HEX)
        begin, end = runs(buf, bounds, members, least_length)
        # Candidates, joined, score in one go.
        width = end - begin
        edges = np.concatenate([[0], np.cumsum(width)])
        at = np.repeat(begin - edges[:-1], width) + np.arange(edges[-1])
        likely = ratios(buf[at], edges, model, True) >= least_ratio
        begin, end = begin[likely], end[likely]
        hex_from, from_ = np.searchsorted(hex_begin, bounds), np.searchsorted(begin, bounds)
        for i in range(len(bounds) - 1):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            own_hex = slice(hex_from[i], hex_from[i + 1])
            own_ = slice(from_[i], from_[i + 1])
            raw = buf[lo:hi]
            found = rule_spans(raw.tobytes(), list(zip((hex_begin[own_hex] - lo).tolist(), (hex_end[own_hex] - lo).tolist(), strict=True)))
            spans = [(a, k, b) for a, k, b, _ in found]
            if from_[i] < from_[i + 1]:
                # Rules' spans may overlap each other: a candidate is free if as many end before it as begin before its end.
                starts, ends = np.sort([s[0] for s in spans]), np.sort([s[2] for s in spans])
                a, b = begin[own_] - lo, end[own_] - lo
                free = np.searchsorted(ends, a, "right") == np.searchsorted(starts, b, "left")
                spans += [(x, len(BASE_KINDS), y) for x, y in zip(a[free].tolist(), b[free].tolist(), strict=True)]
            spans.sort()
            if not spans:
                yield []
                continue
            points = _points(raw, np.array([[s[0], s[2]] for s in spans])).tolist()
            yield [{"kind": listed[s[1]], "start": x, "end": y} for s, (x, y) in zip(spans, points, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for block in text_blocks(batch.column(batch.num_columns - 1)) for s in of_block(block.buf, block.bounds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, spans_kind)], [*batch.schema.names[:-1], "spans"])

    return named.mapInArrow(run, f"{kinds}spans {SPANS}").toDF(*names, "spans")


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document: how many spans each rule finds, a digest of the rules' spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"), learn(docs))
    base = F.filter("spans", lambda s: s["kind"] != MODEL)
    counts = [F.aggregate("spans.kind", F.lit(0).cast("long"), lambda n, kind: n + (kind == F.lit(k)).cast("long")).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
