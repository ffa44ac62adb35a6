"""Tokens of each text by byte-pair merges on ragged arrays, without building any ids.

A text is cut into pre-tokens, as the vocabulary's pre-tokenizer cuts it. The different
pre-tokens that a batch brings are held as one flat array of symbols, beginning with their
bytes, beside the number of the sequence each symbol belongs to. In every round all sequences
look up the ranks of their neighbouring pairs, each takes its lowest one, and all places of
that pair are joined, in all sequences at once. Sequences without a pair in the vocabulary
leave the arrays; what is left of them is their number of tokens. A text's count is the sum over its
pre-tokens, and a pre-token met before needs no rounds.

A pre-token of over ``LONG`` bytes is worked on by itself in the same order of ranks, but each
round visits only the places of the pair it joins, so a word of millions of letters costs
n log n steps and not a pass over it for every rank.

Joining all places of a pair in one round equals joining them one by one because a pair that
holds a symbol always has a higher rank than the pair that made it; a vocabulary for which
this does not hold is refused, as is one of another kind (a normalizer, no byte level).

Rows are independent, nothing shuffles, and a task holds one Arrow batch, ``SLICE`` characters
of cut text and at most ``REMEMBERED`` counts. Defined results: a null or empty text has 0 bytes and 0
tokens; null or repeated doc_ids have a row for each of their rows; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import claim, ship
from tallyspark.llm.token_shards import public_tokenizer

#: A document of more tokens is over the limit.
LIMIT = 512
#: Characters of a text that are cut into pre-tokens at a time, about.
SLICE = 1_000_000
#: Bytes from which a pre-token is worked on by itself.
LONG = 2_000
#: Pre-tokens whose counts a Python worker remembers, none of over SHORT characters.
REMEMBERED, SHORT = 1_000_000, 64
#: Bytes of new pre-tokens that are merged at a time.
BATCH_BYTES = 4_000_000

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# Fixed value: the pattern by which byte-level vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# characters that are of one kind in every version of Unicode since 5.0 and for every library
_AGREED = "\t\n\r -~\xa1-ȳͰ-ͳΑ-ΡΣ-ώЀ-҂Ҋ-ҿا-غف-يअ-हぁ-ゖァ-ヺ一-龥가-힣‐-‧‰-⁞、-〃「-】！-～"
_ODD = regex.compile(f"[^{_AGREED}]")
_PRE_TOKEN = regex.compile(PATTERN)
# a pre-token always begins at a space between a letter or digit and something else than
# white space, and at a letter behind a sign other than the apostrophe
_SAFE_CUT = regex.compile(r"(?<=[\p{L}\p{N}])(?= \S)|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for those from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (byte for byte in range(256) if byte not in set(printable))
    letters = {byte: chr(byte) for byte in printable}
    letters.update({byte: chr(256 + n) for n, byte in enumerate(others)})
    return [letters[byte] for byte in range(256)]


class Merges:
    """The pairs of a vocabulary: ranks of pairs of symbols, and what they join to."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.first = np.array([vocabulary[letter] for letter in byte_letters()], np.int64)
        self.size = max(vocabulary.values()) + 1
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        rank_made = np.full(self.size, -1, np.int64)
        rank_made[self.made[::-1]] = np.arange(len(merges))[::-1]
        if len(np.unique(self.made)) < len(merges) or (
            np.maximum(rank_made[left], rank_made[right]) >= np.arange(len(merges))
        ).any():
            raise ValueError("a symbol of this vocabulary is joined before it is made")
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE for pairs the vocabulary does not join."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], _NONE)


def _every_other(follows: np.ndarray) -> np.ndarray:
    """Of each run of overlapping places the first, third, fifth … one; ``follows`` tells
    whether a place overlaps the one before it."""
    at = np.arange(len(follows))
    return (at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 0


def merged_sizes(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """Symbols left of each piece once nothing more joins; pieces are not empty."""
    sizes = np.zeros(len(pieces), np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = merges.first[np.frombuffer(b"".join(pieces), np.uint8)]
    owners = np.repeat(np.arange(len(pieces)), lengths)
    while len(symbols):
        ranks = merges.ranks(symbols[:-1], symbols[1:])
        ranks = np.append(np.where(owners[:-1] == owners[1:], ranks, _NONE), _NONE)
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        lengths = np.diff(starts, append=len(owners))
        lowest = np.minimum.reduceat(ranks, starts)
        done = lowest == _NONE
        sizes[owners[starts[done]]] = lengths[done]
        places = np.flatnonzero((ranks == np.repeat(lowest, lengths)) & (ranks != _NONE))
        places = places[_every_other(np.diff(places, prepend=-2) == 1)]
        symbols[places] = merges.made[ranks[places]]
        live = np.repeat(~done, lengths)
        live[places + 1] = False
        symbols, owners = symbols[live], owners[live]
    return sizes


def merged_size(piece: bytes, merges: Merges) -> int:
    """As ``merged_sizes`` for one long piece: a round takes one rank and visits its places."""
    symbols = merges.first[np.frombuffer(piece, np.uint8)]
    end = len(symbols)
    after = np.arange(1, end + 1)
    before = np.arange(-1, end)  # one more, for what stands behind the last symbol
    alive = np.ones(end, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def wait(places: np.ndarray) -> None:
        """Puts the pairs that begin at these places where their rank will find them."""
        places = places[places >= 0]
        places = places[after[places] < end]
        ranks = merges.ranks(symbols[places], symbols[after[places]])
        order = np.argsort(ranks, kind="stable")
        order = order[: np.searchsorted(ranks[order], _NONE)]
        ranks, places = ranks[order], places[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, group in zip(ranks[starts].tolist(), np.split(places, starts[1:]), strict=False):
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(heap, rank)
            waiting[rank].append(group)

    wait(np.arange(end))
    while heap:
        rank = heapq.heappop(heap)
        places = np.unique(np.concatenate(waiting.pop(rank)))
        places = places[alive[places] & (symbols[places] == merges.left[rank])]
        places = places[after[places] < end]
        places = places[symbols[after[places]] == merges.right[rank]]
        if not len(places):
            continue
        follows = np.append(False, after[places[:-1]] == places[1:])
        places = places[_every_other(follows)]
        gone = after[places]
        symbols[places], alive[gone] = merges.made[rank], False
        after[places] = after[gone]
        before[after[places]] = places
        wait(np.unique(np.concatenate([before[places], places])))
    return int(alive.sum())


class Counter:
    """Counts the tokens of texts as one tokenizers file of the byte-level kind gives them."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        told = json.loads(tokenizer_json)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(
            model.get(key)
            for key in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        )
        level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        ends = [token["content"] for token in told["added_tokens"] if token["lstrip"] or token["rstrip"] or token["single_word"]]
        if not plain or not level or told["normalizer"] or ends:
            raise ValueError("this vocabulary is not of the plain byte-level kind")
        pairs = [tuple(pair.split(" ") if isinstance(pair, str) else pair) for pair in model["merges"]]
        self.merges = Merges(model["vocab"], pairs)
        self.library = Tokenizer.from_str(tokenizer_json)
        added = sorted((token["content"] for token in told["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def _pre_tokens(self, text: str, start: int, end: int) -> list[str]:
        """The pre-tokens of a span of a text; characters on which libraries may differ are
        left to the vocabulary's own library."""
        if not _ODD.search(text, start, end):
            return _PRE_TOKEN.findall(text, start, end)
        part = text[start:end]
        return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def _spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of about SLICE characters that no pre-token crosses."""
        start = 0
        while start < len(text):
            cut = _SAFE_CUT.search(text, start + SLICE) if len(text) - start > SLICE else None
            end = cut.start() if cut else len(text)
            yield start, end
            start = end

    def _learn(self, new: set[str]) -> dict[str, int]:
        """The counts of pre-tokens not met before."""
        counts: dict[str, int] = {}
        batch: list[str] = []
        pieces: list[bytes] = []
        held = 0
        for word in sorted(new):
            piece = word.encode()
            if len(piece) > LONG:
                counts[word] = merged_size(piece, self.merges)
                continue
            batch.append(word)
            pieces.append(piece)
            held += len(piece)
            if held > BATCH_BYTES:
                counts.update(zip(batch, merged_sizes(pieces, self.merges).tolist(), strict=True))
                batch, pieces, held = [], [], 0
        counts.update(zip(batch, merged_sizes(pieces, self.merges).tolist(), strict=True))
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text. Spans of texts are gathered up to SLICE
        characters, so that their new pre-tokens are merged together."""
        claim(self.known)
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for number, text in enumerate(texts):
            parts = self.added.split(text) if self.added else [text]
            totals[number] += len(parts) - 1
            for part in parts:
                for start, end in self._spans(part):
                    held.append((number, self._pre_tokens(part, start, end)))
                    chars += end - start
                    if chars > SLICE:
                        self._add(totals, held)
                        held, chars = [], 0
        self._add(totals, held)
        return totals

    def _add(self, totals: list[int], held: list[tuple[int, list[str]]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        met: set[str] = set()
        for _, words in held:
            met.update(words)
        counts = self._learn(met.difference(self.known))
        self.known.update((word, n) for word, n in counts.items() if len(word) <= SHORT)
        long = {word: n for word, n in counts.items() if len(word) > SHORT}
        for number, words in held:
            if long:
                totals[number] += sum(long[w] if w in long else self.known[w] for w in words)
            else:
                totals[number] += sum(map(self.known.__getitem__, words))


_COUNTERS: dict[int, Counter] = {}


def counter(tokenizer_json: str) -> Counter:
    """The counter of a vocabulary, made once in a Python worker."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(tokenizer_json)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, tokenizer_json: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(tokenizer_json or public_tokenizer())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model.value)
        for batch in batches:
            texts = batch.column(1)
            totals = pa.array(tokens.count(texts.to_pylist()), pa.int64())
            columns = [batch.column(0), pc.binary_length(texts).cast(pa.int64()), totals, pc.greater(totals, limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, COUNTS)
