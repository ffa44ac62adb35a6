"""Token ids in binary shards, found by key through minimal perfect hashes.

A folder holds

- ``shard-NNNNN.ids``: the ids of its documents one after the other, little-endian, two bytes
  each if the vocabulary has at most 65,536 ids and else four; documents are in ascending
  order of doc_id, within a shard and from shard to shard;
- ``index-NNNNN.mph``: for the keys whose hash falls to it, a minimal perfect hash and, by
  its slots, a fingerprint of the key, the shard, the first id's place and the number of ids.

A minimal perfect hash is a row of bit arrays. A key sets a bit of the first array at which no
other key of that level falls on the same place; the rank of that bit among all set bits is
its slot. A lookup takes a bounded expected number of probes, and the fingerprint tells
unknown keys with an error of 2^-32.

Documents are sorted by range before they are encoded, so that shards are written in a stream
and texts move once. Files get their name when they are complete; a repeated task replaces
its file with the same bytes.

The key is doc_id and, for repeated ids, the number of the row among them (by text). Defined
results: a null text is empty and has the end id alone; rows without doc_id come first and
have keys of their own; an empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import claim, ship, stash
from tallyspark.session import scratch_folder

END_ID = 0
#: Characters of text in a shard, about; more if there would be over MOST_SHARDS.
SHARD_CHARS = 16_000_000
MOST_SHARDS = 20_000
#: Keys of an index part: few while there are few parts, never over MOST_KEYS.
FEW_KEYS, MANY_PARTS, MOST_KEYS = 2048, 4096, 1_000_000
#: Bits of a level's array for each key that reaches it.
GAMMA = 2
#: Text units whose ids a Python worker remembers before it starts anew: some 200 MB.
REMEMBERED_UNITS = 1_000_000
#: Units whose ids are gathered at a time, which bounds memory in very long texts.
GATHERED_UNITS = 500_000

RECORD = "doc_id long, ordinal long, shard int, first long, n_tokens long"
_MAGIC = b"TLYMPH01"
# What the pre-tokenizer counts as white space beyond the space.
_OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(
    map(chr, range(0x2000, 0x200B))
)
_CUT = "\0"
_IN_ONE_PIECE = f" [ {_OTHER_SPACE}]|{_CUT}"
# letters and others on which all versions of Unicode agree
_WORD_END = r"([A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωЀ-ҁ])([\t\n\r!-@\[-`{-~])"


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library.

    The pre-tokenizer always starts a new unit at a space between two other characters and
    behind the last letter of a word, so a text may be cut there and units met before need no
    second encoding. Texts where a space lies inside a longer run of white space, or that hold
    the sign for a cut or an added token such as ``<|endoftext|>``, are encoded in one piece.

    Texts are cut and their different units found by Arrow; the ids of all units met lie in
    one pool, from which those of a text are gathered.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.in_one_piece = "|".join([_IN_ONE_PIECE, *(re.escape(token.content) for token in added)])
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # a token of this kind is written with one character for each of its bytes
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.bytes_of = np.array([len(name or "") for name in names])
        self.places: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        """An empty pool but for place 0, the end id."""
        self.places.clear()
        self.pool = np.array([END_ID], self.type)
        self.bounds = np.array([0, 1], np.int64)

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text encoded in one piece."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def _learn(self, units: list[str]) -> np.ndarray:
        """Adds different new units to the pool and returns their places.

        Those that may stand side by side are encoded as one text, cut by byte lengths.
        """
        plain, others = [], []
        for unit in units:
            inner = unit[1:]
            alone = unit[:1] != " " or not inner or inner.strip() != inner
            (others if alone else plain).append(unit)
        found = self.tokenizer.encode_batch_fast(["".join(plain)], add_special_tokens=False)[0].ids
        ids = np.array(found, np.int64)
        bytes_to = np.cumsum(np.fromiter(map(len, map(str.encode, plain)), np.int64, len(plain)))
        self._keep(plain, ids, np.searchsorted(np.cumsum(self.bytes_of[ids]), bytes_to) + 1)
        pieces = self.tokenizer.encode(others, is_pretokenized=True, add_special_tokens=False)
        words = np.array(pieces.word_ids, np.int64)
        ends = np.searchsorted(words, np.arange(len(others)), "right")
        self._keep(others, np.array(pieces.ids, np.int64), ends)
        return np.fromiter(map(self.places.__getitem__, units), np.int64, len(units))

    def _keep(self, units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        first = len(self.bounds) - 1
        self.places.update(zip(units, range(first, first + len(units)), strict=True))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + ends])
        self.pool = np.concatenate([self.pool, ids.astype(self.type)])

    def _placed(self, units: pa.Array) -> np.ndarray:
        """The place of each unit; new ones are learned."""
        coded = units.dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = np.fromiter((self.places.get(name, -1) for name in names), np.int64, len(names))
        new = np.flatnonzero(known < 0)
        known[new] = self._learn([names[i] for i in new.tolist()])
        return known[coded.indices.to_numpy(zero_copy_only=False)]

    def _gathered(self, places: np.ndarray) -> np.ndarray:
        """The ids of the units at those places, one after the other."""
        parts = [np.empty(0, self.type)]
        for start in range(0, len(places), GATHERED_UNITS):
            part = places[start : start + GATHERED_UNITS]
            low, sizes = self.bounds[part], self.bounds[part + 1] - self.bounds[part]
            moved = np.repeat(low - np.cumsum(sizes) + sizes, sizes)
            parts.append(self.pool[moved + np.arange(len(moved))])
        return np.concatenate(parts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each text has."""
        claim(self.places)
        if len(self.places) > REMEMBERED_UNITS or not self.places:
            self._forget()
        odd = pc.match_substring_regex(texts, self.in_one_piece)
        marked = pc.replace_substring_regex(pc.if_else(odd, "", texts), _WORD_END, rf"\1{_CUT}\2")
        units = pc.split_pattern(pc.replace_substring(marked, " ", f"{_CUT} "), _CUT)
        ends = np.cumsum(units.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        placed = np.insert(self._placed(units.flatten()), ends, 0)
        through = np.cumsum(self.bounds[placed + 1] - self.bounds[placed])
        counts = np.diff(through[ends + np.arange(len(ends))], prepend=0)
        ids = self._gathered(placed)
        pieces = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(pieces):
            found = [self.whole(texts[int(at)].as_py()) for at in pieces]
            sizes = np.array([len(one) for one in found])
            ids = np.insert(ids, np.repeat((np.cumsum(counts) - counts)[pieces], sizes), np.concatenate(found))
            counts[pieces] += sizes
        return ids, counts


def _slices(texts: pa.Array, chars: int = 2_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of about that many characters."""
    through = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = int(through[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(through, before + chars, "right")))
        yield first, texts.slice(first, last - first)
        first = last


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def _file(folder: str, kind: str, number: int) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    ending = {"shard": "ids", "index": "mph"}[kind]
    return system, f"{path}/{kind}-{number:05d}.{ending}"


class _Written:
    """A file that gets its name only when it is complete."""

    def __init__(self, folder: str, kind: str, number: int):
        self.system, self.path = _file(folder, kind, number)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.unfinished = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.unfinished)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.unfinished, self.path)


# --- minimal perfect hash


def _mixed(docs: np.ndarray, ordinals: np.ndarray, seed: int) -> np.ndarray:
    one, two = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    x = ordinals.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % (1 << 64))
    for value in (np.uint64(0), docs.astype(np.int64).view(np.uint64)):
        x = x ^ value
        x = (x ^ (x >> np.uint64(30))) * one
        x = (x ^ (x >> np.uint64(27))) * two
        x = x ^ (x >> np.uint64(31))
    return x


def _fingerprints(docs: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    return (_mixed(docs, ordinals, 1 << 20) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Slots 0 .. n-1 for n different keys; a key is a doc_id and an ordinal."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of booleans
        bits = np.concatenate([*levels, np.zeros(1, bool)])
        self.ranks = np.concatenate([[0], np.cumsum(bits)])
        self.starts = np.cumsum([0, *map(len, levels)])

    @classmethod
    def of(cls, docs: np.ndarray, ordinals: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(docs):
            size = max(64, GAMMA * len(docs))
            at = (_mixed(docs, ordinals, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            docs, ordinals = docs[~alone[at]], ordinals[~alone[at]]
        return cls(levels)

    def slots(self, docs: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were not there, others get any slot."""
        found = np.full(len(docs), -1, np.int64)
        open_ = np.arange(len(docs))
        for number, level in enumerate(self.levels):
            at = (_mixed(docs[open_], ordinals[open_], number) % np.uint64(len(level))).astype(np.int64)
            here = level[at]
            found[open_[here]] = self.ranks[self.starts[number] + at[here]]
            open_ = open_[~here]
        return found


def write_index(folder: str, part: int, docs, ordinals, shards, firsts, counts) -> None:
    hashed = PerfectHash.of(docs, ordinals)
    by_slot = np.empty(len(docs), np.int64)
    by_slot[hashed.slots(docs, ordinals)] = np.arange(len(docs))
    file = _Written(folder, "index", part)
    file.stream.write(_MAGIC + struct.pack("<qq", len(docs), len(hashed.levels)))
    for level in hashed.levels:
        file.stream.write(struct.pack("<q", len(level)))
        file.stream.write(np.packbits(level, bitorder="little").tobytes())
    file.stream.write(_fingerprints(docs, ordinals)[by_slot].tobytes())
    for values, kind in ((shards, "<u4"), (firsts, "<i8"), (counts, "<i8")):
        file.stream.write(np.asarray(values)[by_slot].astype(kind).tobytes())
    file.close()


def lookup(folder: str, part: int, docs: np.ndarray, ordinals: np.ndarray) -> pd.DataFrame:
    """shard, first, n_tokens of each key; shard -1 for keys that are not in the index."""
    system, path = _file(folder, "index", part)
    with system.open_input_stream(path) as stream:
        data = stream.read()
    if data[:8] != _MAGIC:
        raise ValueError(f"{path} is no index")
    count, depth = struct.unpack_from("<qq", data, 8)
    at, levels = 24, []
    for _ in range(depth):
        (size,) = struct.unpack_from("<q", data, at)
        used = -(-size // 8)
        bits = np.frombuffer(data, np.uint8, used, at + 8)
        levels.append(np.unpackbits(bits, bitorder="little")[:size].astype(bool))
        at += 8 + used
    columns = []
    for kind in ("<u4", "<u4", "<i8", "<i8"):
        columns.append(np.frombuffer(data, kind, count, at))
        at += count * np.dtype(kind).itemsize
    slots = PerfectHash(levels).slots(docs, ordinals)
    known = slots >= 0
    known[known] = columns[0][slots[known]] == _fingerprints(docs[known], ordinals[known])
    result = {}
    for name, values in zip(("shard", "first", "n_tokens"), columns[1:], strict=True):
        found = np.full(len(docs), -1, np.int64)
        found[known] = values[slots[known]]
        result[name] = found
    return pd.DataFrame(result)


# --- jobs


def _index_parts(rows: int) -> int:
    return max(1, min(rows // FEW_KEYS, MANY_PARTS), -(-rows // MOST_KEYS))


def _part(parts: int):
    return F.pmod(F.xxhash64("doc_id", "ordinal"), F.lit(parts)).cast("int")


def _keys(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows without doc_id have negative ordinals, so that their keys differ from all others."""
    none = rows["doc_id"].isna().to_numpy()
    ordinals = rows["ordinal"].to_numpy(np.int64)
    return rows["doc_id"].fillna(0).to_numpy(np.int64), np.where(none, -1 - ordinals, ordinals)


def write(docs: DataFrame, folder: str, tokenizer_json: str) -> tuple[DataFrame, int]:
    """Writes shards and index; returns their records and the number of index parts."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // max(SHARD_CHARS, -(-total // MOST_SHARDS))))
    model = spark.sparkContext.broadcast(tokenizer_json)

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(model.value), TaskContext.get().partitionId()
        file, first, before, ordinal = None, 0, None, -1
        for batch in batches:
            records, doc_ids = [], batch.column(0).to_pylist()
            for start, texts in _slices(batch.column(1)):
                ids, counts = encoder.encode(texts)
                file = file or _Written(folder, "shard", shard)
                file.stream.write(ids.tobytes())
                for doc_id, count in zip(doc_ids[start : start + len(texts)], counts.tolist(), strict=True):
                    ordinal = ordinal + 1 if ordinal >= 0 and doc_id == before else 0
                    records.append((doc_id, ordinal, shard, first, count))
                    first, before = first + count, doc_id
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*records, strict=True) if records else [()] * len(kinds)
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "ordinal", "shard", "first", "n_tokens"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if file:
            file.close()

    sorted_rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    records = stash(sorted_rows.mapInArrow(write_shard, RECORD), "records")
    parts = _index_parts(records.count())

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(part)
        places = (part[name].to_numpy(np.int64) for name in ("shard", "first", "n_tokens"))
        write_index(folder, int(key[0]), *keys, *places)
        return pd.DataFrame({"part": [int(key[0])], "keys": [len(part)]})

    built = records.groupBy(_part(parts).alias("part")).applyInPandas(build, "part int, keys long")
    built.agg(F.sum("keys")).first()
    return records, parts


def read(keys: DataFrame, folder: str, parts: int, itemsize: int) -> DataFrame:
    """doc_id, ordinal, shard, first, n_tokens, ids_crc32 of each key (doc_id, ordinal).

    Keys are looked up in their index part, then their ids are read shard by shard. Keys that
    are not in the index give no row.
    """
    ship(keys.sparkSession)

    def find(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = lookup(folder, int(key[0]), *_keys(part))
        found.insert(0, "doc_id", part["doc_id"].to_numpy())
        found.insert(1, "ordinal", part["ordinal"].to_numpy())
        return found[found["shard"] >= 0]

    def load(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        system, path = _file(folder, "shard", int(key[0]))
        shard = shard.sort_values("first")
        sums = []
        with system.open_input_file(path) as file:
            for first, count in zip(shard["first"], shard["n_tokens"], strict=True):
                ids = np.frombuffer(file.read_at(int(count) * itemsize, int(first) * itemsize), f"<u{itemsize}")
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
        return shard.assign(ids_crc32=np.array(sums, np.int64))

    found = (
        keys.select("doc_id", "ordinal").groupBy(_part(parts).alias("part")).applyInPandas(find, RECORD)
    )
    return found.groupBy("shard").applyInPandas(load, f"{RECORD}, ids_crc32 long")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The text of one of the installed public vocabulary files."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def round_trip(docs: DataFrame, tokenizer_json: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes docs and reads them back: doc_id, start, n_tokens, ids_crc32, shard, ordinal.

    ``start`` counts the ids of all documents before, over all shards.
    """
    spark: SparkSession = docs.sparkSession
    model = tokenizer_json or public_tokenizer()
    folder = folder or scratch_folder(spark, "token-shards")
    records, parts = write(docs, folder, model)
    sizes = records.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    line = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = stash(
        sizes.select("shard", F.coalesce(F.sum("held").over(line), F.lit(0)).alias("base")), "bases"
    )
    back = read(records.select("doc_id", "ordinal"), folder, parts, Encoder(model).type.itemsize)
    return back.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "shard", "ordinal"
    )
