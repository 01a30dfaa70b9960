"""Packing of tokenised documents into fixed-length sequences, in the order of a Hilbert curve."""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, partitions, pieces, stash, table

#: Tokens that one range of the curve holds, about.
RANGE_TOKENS = 3_000_000
#: Dimensions of the curve, bits of each, and bits of the document's own hash below them.
DIMS, BITS, TIE_BITS = 4, 10, 23
#: Signs that end a word's letters for the tokenizer.
SIGNS = b".,;:!?%#*$&|"
#: Letters in composed form that Arrow tells from the rest and lower-cases as the tokenizer does; others are tested one by one.
LETTERS = "[a-zÀ-ÖØ-öø-ÿ]"
#: Words whose ids a worker remembers, twice at most.
CACHE_WORDS = 150_000


def default_tokenizer() -> str:
    """Where the public 49k-word tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> dict[int, int]:
    """The character by which a byte-level vocabulary writes each byte: printable ones are themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + rest.index(b) if b in rest else b for b in range(256)}


_BYTE_CHARACTERS = _byte_characters()


def _letters(word: bytes) -> str | None:
    """A word of lower-case letters in composed form as the vocabulary writes it; None for any other word."""
    text = word.decode("utf-8", "replace")
    if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
        return word.decode("latin-1").translate(_BYTE_CHARACTERS)
    return None


#: The same by position, for letters; a line's end stays one.
_LETTER_CHARACTERS = np.array([10 if b == 10 else _BYTE_CHARACTERS[b] for b in range(256)], "<u2")


def _laid(codes: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the entries in ``order`` end to end, and where each ends; entry k is ``codes`` up to ``ends[k]``."""
    sizes = np.diff(ends, prepend=0)
    n = sizes[order]
    stops = np.cumsum(n)
    return codes[np.arange(stops[-1]) + np.repeat(ends[order] - stops, n)], stops


def _listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of texts as a Hugging Face tokenizer that drops white space and lower-cases gives them.

    Such a tokenizer treats each run between blanks on its own, so runs are encoded once and looked up
    afterwards. A run of letters and then signs is two parts to it, and letters alone go straight to its merges.
    Arrow finds a batch's distinct runs and their parts; only distinct words are looked up, and ids are laid out by position.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        self.signs: dict[bytes, bytes] = {}

    def _codes(self, words: list[bytes], plain: list[bool]) -> list[bytes]:
        """The ids of each word; ``plain`` ones are letters that need no test."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, fresh, odd = self.known, [], []
        for word, simple, code in zip(words, plain, map(known.get, words), strict=True):
            if code is None:
                code = self.older.get(word)
                if code is not None:
                    known[word] = code
                else:
                    (fresh if simple else odd).append(word)
        texts = _LETTER_CHARACTERS[np.frombuffer(b"\n".join(fresh), "u1")].tobytes().decode("utf-16-le").split("\n")
        for word, text in zip(fresh, texts if fresh else [], strict=True):
            known[word] = array("I", [t.id for t in self.tokenize(text)]).tobytes()
        mixed = []
        for word in odd:
            base = word.rstrip(SIGNS)
            text = _letters(base)
            if text:
                known[word] = array("I", [t.id for t in self.tokenize(text)]).tobytes() + self._sign(word[len(base) :])
            else:
                mixed.append(word)
        for word, e in zip(mixed, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in mixed], add_special_tokens=False), strict=True):
            known[word] = array("I", e.ids).tobytes()
        return list(map(known.__getitem__, words))

    def _sign(self, signs: bytes) -> bytes:
        if signs not in self.signs:
            if len(self.signs) > 10_000:
                self.signs.clear()
            self.signs[signs] = array("I", self.tokenizer.encode(signs.decode(), add_special_tokens=False).ids).tobytes()
        return self.signs[signs]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        clean = pa.array([t.encode("utf-8", "replace").lower().replace(b"\n", b" ") for t in texts], pa.large_binary()).cast(pa.large_string())
        lists = pc.split_pattern(clean, " ")
        runs = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(runs.dictionary, f"^(?P<base>{LETTERS}+)(?P<signs>[{SIGNS.decode()}]*)$")
        base = pc.coalesce(pc.utf8_lower(pc.struct_field(parts, "base")), runs.dictionary).dictionary_encode()
        signs = pc.fill_null(pc.struct_field(parts, "signs"), "").dictionary_encode()
        codes = self._codes(_listed(base.dictionary.cast(pa.large_binary())), _listed(pc.match_substring_regex(base.dictionary, f"^{LETTERS}+$")))
        words = len(codes)
        codes += [self._sign(x) for x in _listed(signs.dictionary.cast(pa.large_binary()))]
        # ids of the distinct runs, each a word and its signs, then of all runs
        both = np.stack([base.indices.to_numpy(), signs.indices.to_numpy() + words], axis=1).ravel()
        ids, ends = _laid(np.frombuffer(b"".join(codes), "<u4"), np.cumsum([len(c) >> 2 for c in codes]), both)
        ids, ends = _laid(ids, ends[1::2], runs.indices.to_numpy())
        return np.split(ids, ends[lists.offsets.to_numpy()[1:-1] - 1])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder; a worker keeps it, with the words it knows, from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (rows of 0..2**bits-1) along the Hilbert curve of their dimensions."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _directions(vocabulary: int) -> np.ndarray:
    """A fixed projection of each id's hashed coordinate to the dimensions of the curve."""
    return np.random.default_rng(11).standard_normal((vocabulary, DIMS)).astype(np.float32)


def _vectors(ids: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    out = np.zeros((len(ids), DIMS))
    for k, own in enumerate(ids):
        if len(own):
            out[k] = np.bincount(own & 0xFFFF, minlength=1 << 16) @ directions / len(own) if len(own) > 60_000 else np.take(directions, own & 0xFFFF, axis=0).mean(axis=0)
    return out


def _encode(batches: Iterator[pd.DataFrame], path: str, eos: int) -> Iterator[pd.DataFrame]:
    words, directions = encoder(path), _directions(1 << 16)
    for b in pieces(batches, size=1 << 20):
        ids = words.encode([t or "" for t in b["text"]])
        vectors = _vectors(ids, directions)
        ids = [np.append(own, np.uint32(eos)) for own in ids]
        widths = [2 if x.max() < 65536 else 4 for x in ids]
        yield b.drop(columns="text").assign(
            n=[len(x) for x in ids], width=widths, ids=[x.astype("<u2" if w == 2 else "<u4").tobytes() for x, w in zip(ids, widths, strict=True)],
            **{f"v{k}": vectors[:, k] for k in range(DIMS)},
        )


def _keys(vectors: np.ndarray, ties: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    grid = np.clip((vectors - centre) / spread * (1 << (BITS - 3)) + (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    return (hilbert_key(grid, BITS) << TIE_BITS) | (ties & ((1 << TIE_BITS) - 1))


def _last_lengths(rest: int) -> list[int]:
    """Falling powers of two that make up ``rest``, which need no padding."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_PIECE = ["doc_id", "named", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _ids(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if width == 2 else "<u4")


def _cut(docs: list[tuple], filled: int, edges: np.ndarray) -> Iterator[tuple]:
    """Pieces (document's place, start in its ids, length, sequence, offset) of ids laid end to end from ``filled`` on, cut
    at the edges of sequences."""
    ends = filled + np.cumsum([len(d[3]) for d in docs])
    cuts = np.unique(np.concatenate([[filled], ends, edges[(edges > filled) & (edges < ends[-1])]]))
    left, right = cuts[:-1], cuts[1:]
    doc = np.searchsorted(ends, left, side="right")
    sequence = np.searchsorted(edges, left, side="right") - 1
    begins = np.concatenate([[filled], ends[:-1]])
    return zip(doc.tolist(), (left - begins[doc]).tolist(), (right - left).tolist(), sequence.tolist(), (left - edges[sequence]).tolist(), strict=True)


def _pack(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Packs one sorted range as it streams; no more than the ids of one unfinished sequence are held back."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    held: list[tuple] = []  # (doc_id, named, start in the document, ids, doc_tokens) of the unfinished sequence
    done = 0

    def row(d, start, n, sequence, offset):
        return (d[0], d[1], d[2] + start, n, zlib.crc32(d[3][start : start + n].astype("<u4").tobytes()), d[4], base + sequence, offset)

    for b in pieces(batches, "ids", size=4 << 20):
        docs = held + [(d, named, 0, _ids(x, w), n) for d, named, x, w, n in zip(b["doc_id"], b["named"], b["ids"], b["width"], b["n"], strict=True)]
        total = sum(len(d[3]) for d in docs)
        full = total // length
        out, held = [], []
        for k, start, n, sequence, offset in _cut(docs, 0, np.arange(full + 2) * length):
            d = docs[k]
            if sequence < full:
                out.append(row(d, start, n, done + sequence, offset))
            else:
                held.append((d[0], d[1], d[2] + start, d[3][start : start + n].copy(), d[4]))
        done += full
        if out:
            yield pd.DataFrame(out, columns=_PIECE)
    if held:
        edges = np.concatenate([[0], np.cumsum(_last_lengths(sum(len(d[3]) for d in held)))])
        yield pd.DataFrame([row(held[k], start, n, done + sequence, offset) for k, start, n, sequence, offset in _cut(held, 0, edges)], columns=_PIECE)


def pack_documents(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, eos: int = 1) -> DataFrame:
    """Pieces of tokenised documents in sequences of at most ``length`` tokens.

    ``docs`` has doc_id and text (null: empty); other columns are not read. A document is its ids and
    then ``eos``. Its mean token vector, hashed and projected to four dimensions and scaled by the mean and
    deviation of all documents, gives its place on a Hilbert curve; a hash of the row breaks ties, so any
    number of equal documents spreads. Documents are range-sorted by that key, a range for each RANGE_TOKENS tokens about,
    and each range is packed as it streams: ids laid end to end, cut wherever a sequence is full; what is left
    at a range's end makes sequences of falling powers of two. A task holds a batch and one unfinished sequence.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset; rows without a doc_id are packed
    too and keep a null id; rows that repeat a doc_id are packed as often; an empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    modest_batches(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), F.col("text").cast("string"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", F.octet_length("text")))
    axes = [f"v{k}" for k in range(DIMS)]
    tokens = stash(rows.mapInPandas(lambda b: _encode(b, path, eos), f"doc_id long, named boolean, tie long, n long, width int, ids binary, {' double, '.join(axes)} double"), "tokens")
    found = tokens.agg(F.sum("n"), *[F.avg(v) for v in axes], *[F.stddev_pop(v) for v in axes]).first()
    total, centre, spread = found[0] or 0, np.array([x or 0.0 for x in found[1 : DIMS + 1]]), np.array([max(x or 0.0, 1e-9) for x in found[DIMS + 1 :]])

    @F.pandas_udf(T.LongType())
    def key(tie: pd.Series, *vectors: pd.Series) -> pd.Series:
        return pd.Series(_keys(np.stack(vectors, axis=1), tie.to_numpy(), centre, spread))

    ranges = max(partitions(spark), total // RANGE_TOKENS)
    placed = tokens.select(key("tie", *axes).alias("key"), "doc_id", "named", "n", "width", "ids")
    placed = placed.repartitionByRange(ranges, "key", "doc_id", "n").sortWithinPartitions("key", "doc_id", "n", "ids")
    packed = placed.mapInPandas(lambda b: _pack(b, length), "doc_id long, named boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048."""
    return pack_documents(table(spark, sf_dir, "documents"), 2048)
