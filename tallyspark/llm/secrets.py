"""Secret scan: known forms, and strings that a battery of tests finds random.

Known forms (assignments, access keys, long hex strings) are matched in the whole text and
always reported. Beyond them, every run of letters and digits is tested, of whatever length,
and runs joined by signs of ``+/`` or of ``-_`` alone also as a whole. The evidence that a string is random is

- a likelihood ratio: the chance of the string where all characters of an encoding (hex, base32,
  base36, base62, base64) come alike, averaged over the encodings, against its chance as a
  natural name, where letters follow each other as in the whole corpus and kinds of characters
  change as seldom as KINDS_FOLLOW says. Its inverse is a p-value without any approximation;
- or, if that is less, against its chance as a sequence, where most characters repeat the one
  before or come right before or behind it in the alphabet;
- less what the battery takes off: the p-values, if the string were random, of chi-squared
  uniformity of its alphabet, of runs above and below the middle, and of serial correlation of
  neighbours. The smallest of the three times three, where it is below SUSPECT, lowers the
  evidence by its PENALTY-th power, so a string too even, too lumpy or too orderly for chance
  loses what it gains as an unlikely name.

False discoveries among all runs of the corpus are held at FALSE_RATE by the step-up rule on
weighted p-values, with weights in proportion to length: long strings carry more evidence.
p-values are counted in steps of a twentieth of a decade, rounded up, so that only the counts
of the steps reach the driver. Strings whose evidence could not be a discovery even if all runs
were are counted and not listed; most natural words are told apart that way by sums over arrays.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive;
a candidate that overlaps a known form is not reported again; repeated rows give repeated
rows, each counted; a text of any length is read as a whole, some SLICE characters at a time.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import per_value, ship, spread, stash

FALSE_RATE = 0.01
#: Steps of a p-value's decade.
STEPS = 20
#: From this p-value of the battery down, evidence falls by this power of it.
SUSPECT, PENALTY = 0.01, 4
#: Share of characters of a sequence that follow the one before.
FOLLOWING = 0.9
#: Weight of a letter's own share beside its pairs, in pairs.
PAIRS_PRIOR = 50.0
#: A joined run counts as a whole if that has so many times the evidence of its best part.
WHOLE_FROM = 1.3
#: Characters of a text whose evidence is summed at a time.
SLICE = 1_000_000
#: How kinds of characters follow each other in natural names: rows are the kind before (lower
#: case, upper case, digit, sign, none), columns the next one (lower case, upper case, digit, sign).
KINDS_FOLLOW = (
    (0.93, 0.02, 0.02, 0.03),
    (0.45, 0.50, 0.02, 0.03),
    (0.05, 0.05, 0.85, 0.05),
    (0.50, 0.20, 0.25, 0.05),
    (0.60, 0.25, 0.13, 0.02),
)

# The known forms, in the order in which spans are listed.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER, _SIGNS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "+/-_"
_UPPER = _LOWER.upper()
_PLAIN = re.compile(r"[A-Za-z0-9]+")
SCANNED = "array<struct<runs:bigint,chars:bigint,spans:array<struct<start:int,end:int,kind:int,step:int,length:int>>>>"

#: Alphabets from the narrowest on.
ENCODINGS = (
    _DIGITS + "abcdef",
    _DIGITS + "ABCDEF",
    _UPPER + "234567",
    _DIGITS + _LOWER,
    _DIGITS + _UPPER,
    _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "-_",
)
_SIZES = np.array([len(alphabet) for alphabet in ENCODINGS], float)
#: Bit e of a character's code: encoding e has no such character.
_FOREIGN = np.array([sum((chr(c) not in a) << e for e, a in enumerate(ENCODINGS)) for c in range(128)], np.int64)
_START = 128
_KIND = np.array([next((k for k, cs in enumerate((_LOWER, _UPPER, _DIGITS, _SIGNS)) if chr(c) in cs), -1) for c in range(128)])
_LETTER = np.array([_LOWER.find(chr(c).lower()) if chr(c).isalpha() else -1 for c in range(128)])


def _normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(codes: np.ndarray, size: int) -> float:
    """Two-sided p-value of the chi-squared statistic of equal shares (Wilson and Hilferty)."""
    n = len(codes)
    expected = n / size
    statistic = float(((np.bincount(codes, minlength=size) - expected) ** 2).sum()) / expected
    # few characters of a wide alphabet vary less than chi-squared does
    mean, spread = size - 1.0, 2.0 * (size - 1) * (n - 1) / n
    if spread <= 0:
        return 1.0
    free = 2 * mean**2 / spread
    cube = (max(statistic, 0.0) / mean) ** (1 / 3)
    return _normal_tail((cube - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))


def runs(codes: np.ndarray, size: int) -> float:
    """Two-sided p-value of the number of runs above and below the middle."""
    above = codes >= size / 2
    n, high = len(codes), int(above.sum())
    low = n - high
    if not high or not low:
        return min(1.0, 2.0 ** (2 - n))
    mean = 1 + 2 * high * low / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    count = 1 + int((above[1:] != above[:-1]).sum())
    # half a run towards the mean, as counts are whole
    return _normal_tail(max(0.0, abs(count - mean) - 0.5) / math.sqrt(max(spread, 1e-9)))


def serial(codes: np.ndarray) -> float:
    """Two-sided p-value of the correlation of neighbours."""
    centred = codes - codes.mean()
    total = float((centred**2).sum())
    n = len(codes)
    if not total:
        return min(1.0, 2.0 ** (2 - n))
    r = float((centred[1:] * centred[:-1]).sum()) / total
    return _normal_tail((r + 1 / n) * math.sqrt(n))


def _codes(text: str) -> tuple[np.ndarray, int]:
    """Places in the narrowest alphabet that has all characters, and its size."""
    alphabet = next(a for a in ENCODINGS if set(text) <= set(a))
    place = {c: i for i, c in enumerate(alphabet)}
    return np.array([place[c] for c in text]), len(alphabet)


def battery(text: str) -> float:
    """The p-value of the three tests together, if the string were random."""
    codes, size = _codes(text)
    return min(1.0, 3 * min(uniformity(codes, size), runs(codes, size), serial(codes)))


def against_sequence(text: str) -> float:
    """log10 of the likelihood ratio of random characters against a sequence."""
    codes, size = _codes(text)
    follows = int((np.abs(np.diff(codes)) <= 1).sum())
    other = -math.log10(1 - FOLLOWING)
    return (len(text) - 1) * other - follows * (other + math.log10((1 - FOLLOWING) / size + FOLLOWING / 3) + math.log10(size))


class Evidence:
    """Evidence of randomness against natural names with the corpus's pairs of letters.

    ``pairs`` counts how often a letter (of either case) follows another in all texts.
    """

    def __init__(self, pairs: np.ndarray):
        pairs = pairs.astype(float)
        shares = (pairs.sum(axis=0) + 1) / (pairs.sum() + 26)
        follow = (pairs + PAIRS_PRIOR * shares) / (pairs.sum(axis=1, keepdims=True) + PAIRS_PRIOR)
        kinds = np.array(KINDS_FOLLOW)
        #: log10 of the chance of a character behind another one, or first
        self.natural = np.full((_START + 1, 128), 0.0)
        for after in range(128):
            kind, letter = _KIND[after], _LETTER[after]
            if kind < 0:
                continue
            own = shares[letter] if letter >= 0 else 1 / 10 if kind == 2 else 1 / len(_SIGNS)
            for before in (*np.flatnonzero(_KIND >= 0), _START):
                first = _LETTER[before] if before < _START else -1
                value = follow[first, letter] if first >= 0 and letter >= 0 else own
                self.natural[before, after] = math.log10(kinds[_KIND[before] if before < _START else 4, kind] * value)

    def ratios(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of the likelihood ratio of each string starts[i] .. ends[i] of some codes."""
        lengths = ends - starts
        places = spread(starts, lengths)
        first = np.cumsum(lengths) - lengths
        now, before = codes[places], codes[places - 1]
        before[first] = _START
        natural = np.add.reduceat(self.natural[before, now], first)
        foreign = np.bitwise_or.reduceat(_FOREIGN[now], first)
        fits = (foreign[:, None] >> np.arange(len(ENCODINGS))) & 1 == 0
        logs = np.where(fits, -lengths[:, None] * np.log10(_SIZES), -np.inf)
        top = logs.max(axis=1, initial=-1e300, keepdims=True)
        sums = np.maximum((10.0 ** (logs - top)).sum(axis=1), 1e-300)
        random = top[:, 0] + np.log10(sums) - math.log10(len(ENCODINGS))
        return np.where(fits.any(axis=1), random, -np.inf) - natural

    def step(self, text: str, ratio: float) -> int:
        """The evidence in steps, rounded down, after sequences and the battery."""
        if len(text) < 4:
            return 0
        taken = PENALTY * min(0.0, math.log10(max(battery(text), 1e-300) / SUSPECT))
        return max(0, math.floor((min(ratio, against_sequence(text)) + taken) * STEPS))

    def candidates(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, ratio) of strings that could be discoveries, none overlapping another."""
        least = -math.log10(FALSE_RATE)
        # a sign before the text lets every string have a character before it
        codes = np.frombuffer(f" {text}".encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 128, codes, 0).astype(np.int64)
        for slice_start, slice_end in _slices(codes):
            here = codes[slice_start:slice_end]
            plain = (_KIND[here] >= 0) & (_KIND[here] < 3)
            edge = np.diff(plain.astype(np.int8), prepend=0, append=0)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if not len(starts):
                continue
            ratios = self.ratios(here, starts, ends)
            # joined: only signs stand between a string and the next
            signs = np.concatenate([[0], np.cumsum(_KIND[here] != 3)])
            joined = np.append(signs[starts[1:]] == signs[ends[:-1]], False)
            group = np.cumsum(np.append(False, ~joined[:-1]))
            lone = ~joined & ~np.append(False, joined[:-1])
            for i in np.flatnonzero(lone & (ratios >= least)):
                yield slice_start + int(starts[i]) - 1, slice_start + int(ends[i]) - 1, float(ratios[i])
            for members in _groups(group[~lone], np.flatnonzero(~lone)):
                for first, last, ratio in self._parts(here, starts, ends, members, ratios, least):
                    yield slice_start + first - 1, slice_start + last - 1, ratio

    def _parts(self, here, starts, ends, members, ratios, least) -> list[tuple[int, int, float]]:
        """Of strings that signs join: joined ones that have more evidence than their parts, the
        strongest first, and parts of no such one."""
        wholes = []
        for low, high in _joined(here, starts, ends, members):
            inner = members[low:high]
            ratio = float(self.ratios(here, starts[inner[:1]], ends[inner[-1:]])[0])
            if ratio >= max(least, WHOLE_FROM * max(0.0, float(ratios[inner].max()))):
                wholes.append((-ratio, low, high))
        free = np.ones(len(members), bool)
        found = []
        for ratio, low, high in sorted(wholes):
            if free[low:high].all():
                free[low:high] = False
                found.append((int(starts[members[low]]), int(ends[members[high - 1]]), -ratio))
        alone = members[free & (ratios[members] >= least)]
        found += [(int(starts[i]), int(ends[i]), float(ratios[i])) for i in alone]
        return sorted(found)

    def scan(self, text: str | None) -> list[dict]:
        """One row: the number of runs and their characters, known spans, candidates with steps."""
        text = text or ""
        found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
        spans = [{"start": a, "end": b, "kind": k, "step": 0, "length": b - a} for a, b, k in found]
        for start, end, ratio in self.candidates(text):
            if not any(a < end and start < b for a, b, _ in found):
                step = self.step(text[start:end], ratio)
                if step:
                    spans.append({"start": start, "end": end, "kind": 3, "step": step, "length": end - start})
        lengths = [len(run) for run in _PLAIN.findall(text)]
        return [{"runs": len(lengths), "chars": sum(lengths), "spans": spans}]


def _joined(here, starts, ends, members) -> list[tuple[int, int]]:
    """(low, high) of the longest stretches of members that signs of one kind of base64 join."""
    found = set()
    for family in ("+/", "-_"):
        others = np.concatenate([[0], np.cumsum((_KIND[here] == 3) & ~np.isin(here, [ord(c) for c in family]))])
        breaks = others[starts[members[1:]]] != others[ends[members[:-1]]]
        edges = [0, *(np.flatnonzero(breaks) + 1).tolist(), len(members)]
        found |= {(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1}
    return sorted(found)


def _slices(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about SLICE codes that begin with a code that is in no string."""
    start = 0
    while start < len(codes):
        end = min(start + SLICE, len(codes))
        while end < len(codes):
            breaks = np.flatnonzero(_KIND[codes[end : end + SLICE]] < 0)
            end = end + int(breaks[0]) if len(breaks) else min(end + SLICE, len(codes))
            if len(breaks):
                break
        yield start, end
        start = end


def _groups(keys: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.flatnonzero(np.diff(keys)) + 1) if len(keys) else []


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """How often each letter follows each other one in all texts, upper case as lower case."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(26 * 26, np.int64)
        for batch in batches:
            for text in batch.column(0):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                letters = np.where(data < 128, _LETTER[data & 127], -1)
                both = (letters[:-1] >= 0) & (letters[1:] >= 0)
                total += np.bincount(letters[:-1][both] * 26 + letters[1:][both], minlength=26 * 26)
        codes = pa.array(range(26 * 26), pa.int32())
        yield pa.RecordBatch.from_arrays([codes, pa.array(total, pa.int64())], ["pair", "n"])

    counts = np.zeros(26 * 26, np.int64)
    counted = docs.select("text").mapInArrow(count, "pair int, n long")
    for row in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row["pair"]] = row["n"]
    return counts.reshape(26, 26)


def _weighted(step, length, mean: float):
    return F.floor(step + STEPS * F.log10(length / F.lit(mean))).cast("int")


def least_step(scanned: DataFrame) -> tuple[int, float]:
    """The step-up rule: (steps of p over weight that a discovery needs, mean length of a run).

    A candidate's weighted p-value is p * mean length / length; its number of steps is
    rounded down, which errs on the side of fewer discoveries. All runs are tests, also those
    that are not listed because they could not be discoveries.
    """
    total, chars = scanned.agg(F.sum("runs"), F.sum("chars")).first()
    if not total:
        return 0, 1.0
    mean = chars / total
    candidates = scanned.select(F.explode("spans").alias("s")).select("s.*").filter("kind = 3")
    steps = _weighted(F.col("step"), F.col("length"), mean)
    counts = candidates.groupBy(steps.alias("steps")).count().collect()
    through, least = 0, 1 << 30
    for row in sorted(counts, key=lambda r: -r["steps"]):
        through += row["count"]
        if 10 ** (-row["steps"] / STEPS) <= FALSE_RATE * through / total:
            least = row["steps"]
    return least, float(mean)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every document."""
    evidence = Evidence(letter_pairs(docs))
    found = docs.select("doc_id", per_value(evidence.scan, SCANNED)("text")[0].alias("found"))
    scanned = stash(found.select("doc_id", "found.*"), "spans")
    least, mean = least_step(scanned)
    kept = F.filter("spans", lambda s: (s["kind"] < 3) | (_weighted(s["step"], s["length"], mean) >= least))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    kinds = F.array(*(F.lit(kind) for kind in KINDS))

    def listed(spans):
        one = F.transform(
            spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(one, ",")

    def number(kind: int):
        return F.size(F.filter("o", lambda s: s["kind"] == kind)).cast("long")

    base = listed(F.filter("o", lambda s: s["kind"] < 3))
    return scanned.select("doc_id", ordered.alias("o")).select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        number(3).alias("n_random"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        listed(F.col("o")).alias("spans"),
    )
