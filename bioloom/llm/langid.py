"""Language ID with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot holds a mask with one bit per language, and the
AND of an n-gram's slots is the set of languages that contain it. Per text, the set bits are counted for each
language, corrected for that language's rate of false positives, and the greatest count decides.

N-grams are of ``GRAM`` bytes of the lower-cased text in which ASCII other than letters is a space. A language
holds the n-grams it uses at least ``SHARE`` times as often as the language that uses them most. They are
learned from a bounded sample: about ``SAMPLE`` labelled texts of each language, chosen by a hash of the id. Tasks set the
bits and Spark joins them, so the driver gets the filter itself, not the n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from bioloom.llm.blocks import Block, lean, mix64, text_pieces
from bioloom.session import stored

GRAM = 4
SAMPLE = 3000
SHARE = 0.25
HASHES = 3
SLOTS_PER_GRAM = 16
#: Up to so many languages, their sizes go to every task; with more, texts are shuffled to them.
BROADCAST_LANGUAGES = 10_000
UNDECIDED = "und"
LETTER = regex.compile(r"\p{L}")


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is kept from learning, by the CRC-32 of its id as text (a null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def _symbols() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    kept = np.zeros(128, bool)
    kept[65:91] = kept[97:123] = True
    table[:128][~kept] = 32
    return table


def grams(buf: np.ndarray, bounds: np.ndarray, opened: bool = True, ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of a block and, for each document, where its codes begin. Each text gets two spaces on either side.

    A first text that is not ``opened`` here, or a last one that is not ``ended``, gets none on that side: it is a piece, and the
    next piece repeats its last ``GRAM - 1`` bytes.
    """
    pad = GRAM - 2
    docs = len(bounds) - 1
    lengths = np.diff(bounds)
    wide = np.full(len(buf) + 2 * pad * docs, 32, np.uint8)
    shift = np.repeat(np.arange(docs) * 2 * pad + pad, lengths)
    wide[np.arange(len(buf)) + shift] = _symbols()[buf]
    starts = bounds + 2 * pad * np.arange(docs + 1)
    if not ended:
        wide, starts = wide[:-pad], np.append(starts[:-1], starts[-1] - pad)
    if not opened:
        wide, starts = wide[pad:], np.append(0, starts[1:] - pad)
    codes = np.zeros(max(0, len(wide) - GRAM + 1), np.uint32)
    for i in range(GRAM):
        codes = (codes << np.uint32(8)) | wide[i : len(wide) - GRAM + 1 + i]
    inside = np.ones(len(codes) + GRAM, bool)
    for i in range(1, GRAM):
        inside[starts[1:] - i] = False
    inside = inside[: len(codes)]
    counts = np.maximum(np.diff(starts) - GRAM + 1, 0)
    return codes[inside], np.concatenate([[0], np.cumsum(counts)])


def gram_blocks(column: pa.Array) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Blocks of a column with their codes; long texts in pieces, no n-gram twice."""
    for block in text_pieces(column, overlap=GRAM - 1):
        yield block, *grams(block.buf, block.bounds, block.start == 0, block.ended)


@dataclass
class Filters:
    """The bit-sliced filter: ``slots[i]`` holds the language bits of slot ``i``, 64 languages a word."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def build(cls, languages: list[str], owner: np.ndarray, codes: np.ndarray) -> Filters:
        size = cls.size(int(np.bincount(owner, minlength=1).max()) if len(owner) else 1)
        return cls.of_bits(languages, size, *cls.bits(owner, codes, size))

    @staticmethod
    def size(most: int) -> int:
        """Slots for languages of up to ``most`` n-grams."""
        return 1 << max(10, (SLOTS_PER_GRAM * most - 1).bit_length())

    @classmethod
    def bits(cls, owner: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, words and masks that n-grams of languages set; every slot and word once."""
        at = np.concatenate([x * 65536 + owner // 64 for x in cls.places(codes, size)])
        mask = np.tile(np.uint64(1) << (owner % 64).astype(np.uint64), HASHES)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        mask = np.bitwise_or.reduceat(mask[order], first) if len(at) else mask
        return at[first] // 65536, at[first] % 65536, mask

    @classmethod
    def of_bits(cls, languages: list[str], size: int, slot: np.ndarray, word: np.ndarray, mask: np.ndarray) -> Filters:
        slots = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
        slots[slot, word] = mask
        fill = [np.count_nonzero(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / size for i in range(len(languages))]
        return cls(languages, slots, np.array(fill) ** HASHES)

    @staticmethod
    def places(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
        mixed = mix64(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        for i in range(HASHES):
            yield ((mixed >> np.uint64(21 * i)) & np.uint64(size - 1)).astype(np.int64)

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """The masks of all languages that contain each n-gram."""
        first, *rest = self.places(codes, len(self.slots))
        masks = self.slots[first]
        for at in rest:
            masks &= self.slots[at]
        return masks

    def hits(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each language and document, how many of its n-grams are found there."""
        masks, out = self.lookup(codes), np.zeros((len(self.languages), len(starts) - 1), np.int64)
        for i in range(len(self.languages)):
            sums = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1), out=sums[1:])
            out[i] = sums[starts[1:]] - sums[starts[:-1]]
        return out

    def decide(self, hits: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the index of its language (ties: the first) and the corrected share of its n-grams found there."""
        wrong = self.false_positive[:, None]
        share = (hits / np.maximum(total, 1) - wrong) / np.maximum(1e-9, 1 - wrong)
        best = share.argmax(0)
        return best, np.clip(share[best, np.arange(len(best))], 0.0, 1.0)


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters from rows with a language; other rows teach nothing. Languages are in code point order.

    Every language with a labelled text is one that may be predicted. The driver gets the filter, not n-grams or texts.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("draw")
    )
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("lang", "of"), "languages")
    if sizes.count() <= BROADCAST_LANGUAGES:
        # Else the texts of a language would meet in one partition.
        sizes = F.broadcast(sizes)
    span = F.lit(2.0**64)
    drawn = rows.join(sizes, F.col("lang") == F.col("of")).where(
        (F.col("draw") / span + 0.5) * F.col("rows") < sample
    ).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            index = names.indices.to_numpy(zero_copy_only=False)
            for block, codes, starts in gram_blocks(batch.column(1)):
                owner = np.repeat(index[block.first : block.last].astype(np.uint64), np.diff(starts))
                both, n = np.unique(owner << np.uint64(32) | codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [names.dictionary.take(pa.array((both >> np.uint64(32)).astype(np.int64))), pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )

    counts = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    shares = counts.join(totals, F.col("lang") == F.col("of")).withColumn("share", F.col("n") / F.col("total"))
    most = F.max("share").over(Window.partitionBy("gram"))
    kept = stored(shares.withColumn("most", most).where(F.col("share") >= SHARE * F.col("most")).select("lang", "gram"), "grams")
    languages = sorted(r["of"] for r in sizes.select("of").collect())
    size = Filters.size(max((r["n"] for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()), default=1))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            known = np.array([index[x] for x in names.dictionary.to_pylist()], np.int64)
            owner = known[names.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)
            slot, word, mask = Filters.bits(owner, batch.column(1).to_numpy().view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word), pa.array(mask.view(np.int64))], ["slot", "word", "mask"])

    bits = kept.mapInArrow(set_bits, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    slot, word, mask = (bits.column(i).to_numpy().astype(np.int64) for i in range(3))
    return Filters.of_bits(languages, size, slot, word, mask.view(np.uint64))


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (any such columns are replaced).

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned.
    Nothing but the text is looked at.
    """
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNDECIDED], dtype=object)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            best = np.full(batch.num_rows, len(model.languages))
            score = np.zeros(batch.num_rows)
            if model.languages:
                hits, total = np.zeros((len(model.languages), batch.num_rows), np.int64), np.zeros(batch.num_rows, np.int64)
                for block, codes, starts in gram_blocks(column):
                    part = slice(block.first, block.last)
                    hits[:, part] += model.hits(codes, starts)
                    total[part] += np.diff(starts)
                best, score = model.decide(hits, total)
            for i, value in enumerate(column):
                value = value.as_py()
                if value is None or not LETTER.search(value):
                    best[i], score[i] = len(model.languages), 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(lean(run), f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Per document: whether it was kept from learning, its language and the score (the corrected share of its n-grams).

    A null text, or one without a letter, is ``und`` with score 0; any other gets a learned language, the first of those that tie.
    Where no row that teaches has both text and language, every text is ``und``. Repeated rows repeat in the result; a null id is
    not held out by its empty text; an empty table gives no rows. Long texts are read in pieces.
    """
    rows = docs.withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    filters = learn(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), filters).drop("text")
