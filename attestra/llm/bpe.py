"""BPE encoding and decoding by a contiguous rank array.

A word is an array of parts; beside it stands the array of the ranks of neighbouring
parts. The smallest rank is searched by scanning, its right boundary goes, and the
two ranks beside the new part are looked up again. Words beyond ``SCAN_MOST`` parts
use a heap over the same ranks (same result, no quadratic scan).

Texts are cut at ASCII white space, which no token crosses, and pieces and words are
looked up in bounded caches of the Python worker, so the merging runs once per word.

The vocabulary is a file of the ``tokenizers`` library of the kind
``BPE`` with word ends (NFC, lower case, a split pattern, byte-level letters); its
path is a parameter.

Defined results: a null text counts as empty and gives no ids; repeated rows and
repeated ids stay as they are, one result row per input row; other columns are
ignored by the query and kept by the operator.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm import common

NONE = 1 << 60
SCAN_MOST = 48
#: Entries of a cache's generation: a worker holds four generations, some 200 MB.
CACHE_MOST = 150_000
#: Longer words and pieces aren't kept, so the caches are bounded in bytes as well.
KEPT_LENGTH = 64


class Generations(dict):
    """A cache of two generations; the older one goes when the younger is full."""

    def __init__(self, make, most: int = CACHE_MOST):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def byte_letters() -> dict[int, str]:
    """Byte-level letters: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    found, spare = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in found:
            found[b] = chr(256 + spare)
            spare += 1
    return found


class RankBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.letters = byte_letters()
        self.words = Generations(self._word)
        self.pieces = Generations(self._piece)

    def merge(self, parts: list[int]) -> list[int]:
        """The ids of one word from its letters' ids."""
        if len(parts) > SCAN_MOST:
            return self._merge_long(parts)
        table, get = self.ranks, self.ranks.get
        ranks = [(get(p) or (NONE,))[0] for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = table[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = (get((parts[i], parts[i + 1])) or (NONE,))[0]
            if i:
                ranks[i - 1] = (get((parts[i - 1], parts[i])) or (NONE,))[0]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.ranks[a, b][1], False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get((parts[x], parts[y]))):
                    heapq.heappush(heap, (r[0], x, parts[x], parts[y]))
        return [p for p, there in zip(parts, alive, strict=True) if there]

    def _word(self, word: str) -> bytes:
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.suffix
        ids = self.merge([self.vocab[x] for x in letters])
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def piece_ids(self, piece: bytes) -> bytes:
        text, out = piece.decode("utf-8", "replace"), []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                normal = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [self.words[w] for w in self.pattern.findall(normal)]
        return b"".join(out)

    def _piece(self, piece: bytes) -> tuple[bytes, str]:
        """Ids and their decoded text."""
        ids = self.piece_ids(piece)
        return ids, self._decode(ids)

    def _decode(self, ids: bytes) -> str:
        return " ".join(self.tokens[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4))

    def encode_pieces(self, text: bytes) -> list[tuple[bytes, str]]:
        """Ids, as little-endian unsigned 32-bit integers, and decoded text of each piece between ASCII white space."""
        return list(map(self.pieces.__getitem__, text.split()))

    def encode(self, text: str) -> list[int]:
        ids = b"".join([p for p, _ in self.encode_pieces(text.encode())])
        return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]

    def decode_pieces(self, pieces: list[tuple[bytes, str]]) -> str:
        return " ".join([t for p, t in pieces if p])

    def decode(self, ids: list[int]) -> str:
        return self._decode(b"".join(i.to_bytes(4, "little") for i in ids))


_LOADED: dict[str, RankBPE] = {}


def tokenizer(path: str) -> RankBPE:
    if path not in _LOADED:
        _LOADED[path] = RankBPE(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """The columns of ``docs`` plus n_tokens, ids (binary, little-endian unsigned 32-bit), decoded.

    With ``keep_ids`` false the ids and the decoded text are replaced by their digests
    (ids_sha256, decoded_sha256), so that they needn't travel back from Python. Columns
    of these names in the input are replaced."""
    path = path or default_path()
    own = {"n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in (("n_tokens", "long"), ("ids", "binary"), ("decoded", "string")) if keep_ids else (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            count, ids, texts = [], [], []
            for x in batch.column("text"):
                pieces = bpe.encode_pieces((x.as_py() or "").encode())
                one, text = b"".join([p for p, _ in pieces]), bpe.decode_pieces(pieces)
                count.append(len(one) // 4)
                ids.append(one if keep_ids else hashlib.sha256(one).hexdigest())
                texts.append(text if keep_ids else hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(count, pa.int64()), pa.array(ids, pa.binary() if keep_ids else pa.string()), pa.array(texts, pa.string())],
                names=schema.names,
            )
        common.tidy()

    return docs.mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
