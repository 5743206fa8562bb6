"""Text read in the wrong character encoding: found and restored by a hidden Markov model.

One state is clean text; every other state is a pair (encoding the text was written in, encoding it was read in), and one
state is for what is lost (U+FFFD). The observations are the maximal runs of non-ASCII characters with the ASCII
character on either side, for only these change when ASCII-compatible encodings are confused. A pair's emission is the
clean model's probability of the run after the pair's inverse transform, and (almost) nothing where the run has no
inverse. The clean model is a character bigram model counted over the whole corpus, without the texts that hold a run
which is well-formed in a multi-byte pair or U+FFFD. Viterbi labels the runs; each labelled span gets its state's inverse.

Every text is read once, into the runs of its lines; training and labelling work on these. The clean model counts each distinct
line once, so that copies of a text, or a line that stands on every page of a site, count like one.

Defined cases: null text is no case and gives no row; empty and pure ASCII texts are clean; repeated rows are judged
each for itself, and alike; an empty table gives an empty result. A rare sign is known as clean once it stands in more distinct
lines than the model's discount. Numeric references beyond ASCII are read as their characters. Restored text differs from the
given one in the labelled runs only; lost characters stay as they are.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import written

#: (written in, read in, times). Order decides ties.
PAIRS = (
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1250", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp1254", 1),
    ("utf-8", "iso8859-2", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp1257", 1), ("utf-8", "cp852", 1), ("utf-8", "iso8859-15", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2), ("utf-8", "cp1250", 2), ("utf-8", "cp1252", 3),
    ("cp1250", "cp1252", 1), ("cp1250", "latin-1", 1), ("iso8859-2", "latin-1", 1), ("iso8859-2", "cp1250", 1), ("cp1250", "iso8859-2", 1), ("iso8859-2", "cp1252", 1), ("cp1252", "cp1250", 1), ("latin-1", "iso8859-2", 1),
    ("cp1252", "cp850", 1), ("cp1252", "cp437", 1), ("cp1252", "mac_roman", 1), ("mac_roman", "cp1252", 1), ("mac_roman", "latin-1", 1), 
    ("cp1250", "cp852", 1), ("cp1250", "cp437", 1), ("cp1250", "cp850", 1), ("cp1250", "mac_roman", 1), ("cp1252", "cp1251", 1), ("cp1250", "cp1251", 1), ("cp1252", "cp1257", 1), ("cp1250", "cp1257", 1),
)
STATES = ("clean", *(f"{w}>{r}" + (f"*{n}" if n > 1 else "") for w, r, n in PAIRS), "lost")
LOST = len(STATES) - 1
#: A run, with the ASCII characters before and after it; the latter may come before the next run, too.
RUN = re.compile(r"([\x00-\x7f]?)([^\x00-\x7f]+)(?=([\x00-\x7f]?))")
#: References to characters beyond ASCII in markup, which hide runs.
BEYOND = r"[^\x00-\x7f]|&#"
REFERENCE = re.compile(r"&#(\d{3,7}|[xX][0-9a-fA-F]{2,6});")
FLOOR = -80.0
#: Prior chance that a text starts garbled, that a run is the first of a garbled span, and that a span ends at a run.
P_START, P_ENTER, P_LEAVE = 3e-3, 1e-3, 5e-2

_to_byte: dict[str, dict[str, int]] = {}


def _bytes_of(run: str, encoding: str) -> bytes | None:
    """The bytes that were read as ``run``; bytes without a character were passed through as control characters."""
    table = _to_byte.get(encoding)
    if table is None:
        table = {}
        for b in range(255, -1, -1):
            try:
                table[bytes([b]).decode(encoding)] = b
            except UnicodeDecodeError:
                table[chr(b)] = b
        _to_byte[encoding] = table
    try:
        return bytes([table[c] for c in run])
    except KeyError:
        return None


def inverse(run: str, state: int) -> str | None:
    """``run`` as it was written if state's confusion took place, None if that is impossible."""
    if state == 0 or state == LOST:
        return run
    written, read, times = PAIRS[state - 1]
    for _ in range(times):
        raw = _bytes_of(run, read)
        if raw is None:
            return None
        try:
            run = raw.decode(written)
        except UnicodeDecodeError:
            return None
    return run


def _symbol(c: str) -> str:
    """Character class of the model: digits and white space as one each, far scripts by block of 256."""
    if c <= "\x7f":
        return "0" if c.isdigit() else " " if c in " \t\r\n" else c
    return c if c < "✀" else chr(0xF0000 + (ord(c) >> 8))


def _multi_byte(run: str) -> bool:
    return "�" in run or any(PAIRS[s - 1][0] == "utf-8" and inverse(run, s) is not None for s in range(1, LOST))


def _referred(m: re.Match) -> str:
    n = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
    return chr(n) if 127 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m.group()


def plain(text: str) -> str:
    """``text`` with its numeric references to characters beyond ASCII replaced; other markup stays."""
    return REFERENCE.sub(_referred, text) if "&#" in text else text


def runs_of(line: str) -> list[str]:
    """The runs of a line, each between its neighbours."""
    return [before + run + after for before, run, after in RUN.findall(line)]


def _taken_apart(key: str) -> tuple[str, str, str]:
    """(class of the character before, run, class of the character after); the ends of a line are white space."""
    before, after = key[0] <= "\x7f", key[-1] <= "\x7f"
    return _symbol(key[0]) if before else " ", key[before : len(key) - after], _symbol(key[-1]) if after else " "


def read_runs(texts: DataFrame) -> DataFrame:
    """(src, rec_id, runs, hashes) of the texts with characters beyond ASCII: runs line by line, and a hash of each such line."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for src, rec_id, text in zip(part["src"], part["rec_id"], part["text"]):
                text = plain(text.replace("\x00", " "))
                if not text.isascii():
                    lines = [x for x in text.split("\n") if not x.isascii()]
                    hashes = array("q", (xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines))
                    out.append((src, rec_id, "\n".join("\0".join(runs_of(x)) for x in lines), hashes.tobytes()))
            yield pd.DataFrame(out, columns=["src", "rec_id", "runs", "hashes"])

    rows = texts.select("src", "rec_id", "text").filter(F.col("text").rlike(BEYOND))
    return rows.mapInPandas(read, "src string, rec_id bigint, runs string, hashes binary")


def _keys(runs: str) -> list[str]:
    return runs.replace("\n", "\0").split("\0")


def count_bigrams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigrams at the runs of lines that show no multi-byte damage: columns p, c, n."""
    counts: Counter = Counter()
    broken: dict[str, bool] = {}
    for part in parts:
        for line in part["line"]:
            own = line.split("\0")
            for key in own:
                bad = broken.get(key)
                if bad is None:
                    bad = _multi_byte(_taken_apart(key)[1])
                    if len(broken) < 200_000:
                        broken[key] = bad
                if bad:
                    break
            else:
                counts.update(own)
    grams: Counter = Counter()
    for key, n in counts.items():
        before, run, after = _taken_apart(key)
        symbols = [_symbol(c) for c in run]
        for p, c in zip([before, *symbols], [*symbols, after]):
            grams[p, c] += n
    yield pd.DataFrame([(p, c, n) for (p, c), n in grams.items()], columns=["p", "c", "n"])


class CleanModel:
    """Interpolated bigram log-probabilities of non-ASCII runs in context.

    ``discount`` is taken off every count, so that what a damaged text alone contributes can't vouch for itself.
    """

    def __init__(self, grams: list[tuple[str, str, int]], weight: float = 2.0, discount: int = 2):
        grams = [(p, c, n - discount) for p, c, n in grams if n > discount]
        self.pair = {(p, c): n for p, c, n in grams}
        self.left: Counter = Counter()
        ones = {True: Counter(), False: Counter()}
        for p, c, n in grams:
            self.left[p] += n
            ones[c > "\x7f"][c] += n
        self.weight, self.ones = weight, ones
        self.total = {k: sum(v.values()) for k, v in ones.items()}
        #: An unseen character shares the mass of a few occurrences with all unseen ones.
        self.unseen = {k: 0.02 / (self.total[k] + 1) for k in ones}

    def _log(self, p: str, c: str) -> float:
        k = c > "\x7f"
        one = self.ones[k].get(c, 0)
        base = one / (self.total[k] + 1) if one else self.unseen[k]
        return math.log((self.pair.get((p, c), 0) + self.weight * base) / (self.left.get(p, 0) + self.weight))

    def score(self, before: str, run: str, after: str) -> float:
        symbols = [_symbol(c) for c in run]
        return sum(self._log(p, c) for p, c in zip([before, *symbols], [*symbols, after]))


def _emission(model: CleanModel, before: str, run: str, after: str) -> np.ndarray:
    out = np.full(len(STATES), FLOOR)
    out[0] = max(FLOOR + 1, model.score(before, run, after))
    for s in range(1, LOST):
        as_was = inverse(run, s)
        if as_was is not None:  # runs that the confusion leaves as they are hold a span together
            out[s] = max(FLOOR, model.score(before, as_was, after))
    if "�" in run:
        out[LOST], out[0] = -5.0, FLOOR - 20
    elif any("\x80" <= c <= "\x9f" for c in run):
        out[LOST] = min(-25.0, FLOOR / 2)
    return out


_START = np.full(len(STATES), math.log(P_START / (len(STATES) - 1)))
_START[0] = math.log(1 - P_START)
_MOVE = np.full((len(STATES), len(STATES)), math.log(P_ENTER / len(STATES)))
np.fill_diagonal(_MOVE, math.log(1 - P_LEAVE - P_ENTER))
_MOVE[1:, 0] = math.log(P_LEAVE)
_MOVE[0, 0] = math.log(1 - P_ENTER)
_MOVE[0, 1:] = math.log(P_ENTER / (len(STATES) - 1))


def viterbi(emissions: np.ndarray) -> np.ndarray:
    """Most probable states; ties go to the state that stands first."""
    score, back = _START + emissions[0], []
    for e in emissions[1:]:
        step = score[:, None] + _MOVE
        best = step.argmax(axis=0)
        back.append(best)
        score = step[best, np.arange(len(score))] + e
    path = [int(score.argmax())]
    for best in reversed(back):
        path.append(int(best[path[-1]]))
    return np.array(path[::-1])


class Labeller:
    """Labels the runs of whole texts; emissions are kept by run and neighbours."""

    def __init__(self, model: CleanModel):
        self.model, self.known, self.clean = model, {}, set()

    def states(self, keys: list[str]) -> np.ndarray | None:
        """The states of the runs, or None if every run is clean."""
        # If clean is the best emission everywhere, it is the best path: leaving it only costs.
        if self.clean.issuperset(keys):
            return None
        rows, doubt = [], False
        for key in keys:
            e = self.known.get(key)
            if e is None:
                before, run, after = _taken_apart(key)
                e = _emission(self.model, before, run, after)
                if len(self.known) < 300_000:
                    self.known[key] = e
                    if not e.argmax():
                        self.clean.add(key)
            rows.append(e)
            doubt = doubt or bool(e.argmax())
        if not doubt:
            return None
        path = viterbi(np.stack(rows))
        return path if path.any() else None

    def restored(self, text: str) -> tuple[str, bool] | None:
        """``text`` with the inverse of each labelled run in its place, and whether all could be restored; None if it is clean."""
        spots, shown, ends = [], text, [0]
        if "&#" in text:  # where each piece of the text with references read stands in the given one
            pieces, at = [], 0
            for m in REFERENCE.finditer(text):
                char = _referred(m)
                if char != m.group():
                    pieces += [text[at : m.start()], char]
                    spots.append((sum(map(len, pieces[-2:])) + ends[-1] - 1, m.start(), m.end()))
                    ends.append(ends[-1] + len(pieces[-2]) + 1)
                    at = m.end()
            shown = "".join([*pieces, text[at:]])
        starts = [x for x, _, _ in spots]

        def place(i: int, end: bool) -> int:
            """Offset in ``text`` of the character ``i`` of ``shown``, or of its end."""
            k = bisect_right(starts, i) - 1
            if k < 0:
                return i + end
            x, a, b = spots[k]
            return (b if end else a) if x == i else b + i - x - 1 + end

        found, keys, base = [], [], 0
        for line in shown.replace("\0", " ").split("\n"):
            if not line.isascii():
                for m in RUN.finditer(line):
                    found.append((base + m.start(2), base + m.end(2), m[2]))
                    keys.append(m[1] + m[2] + m[3])
            base += len(line) + 1
        path = self.states(keys) if keys else None
        if path is None:
            return None
        out, at, whole = [], 0, True
        for (a, b, run), s in zip(found, path):
            if s:
                fixed = inverse(run, s)
                whole &= fixed is not None and s != LOST
                if fixed is not None and fixed != run:
                    out += [text[at : place(a, False)], fixed]
                    at = place(b - 1, True)
        return "".join([*out, text[at:]]), whole


def clean_model(runs: DataFrame, rounds: int = 2) -> list[tuple[str, str, int]]:
    """Bigram counts over the distinct lines of ``runs``; at most (symbols)**2 rows, the symbols being bounded by ``_symbol``.

    Viterbi training: every further round counts again without the texts that the round before labelled garbled.
    """
    sc, grams = runs.sparkSession.sparkContext, None
    for _ in range(rounds):
        before = sc.broadcast(grams)

        def lines(parts: Iterator[pd.DataFrame], before=before) -> Iterator[pd.DataFrame]:
            labeller = Labeller(CleanModel(before.value)) if before.value else None
            for part in parts:
                own: dict[int, str] = {}
                for text, hashes in zip(part["runs"], part["hashes"]):
                    if labeller is None or labeller.states(_keys(text)) is None:
                        own.update(zip(np.frombuffer(hashes, "<i8").tolist(), text.split("\n")))
                yield pd.DataFrame({"hash": pd.Series(list(own), dtype="int64"), "line": pd.Series(list(own.values()), dtype=object)})

        once = runs.select("runs", "hashes").mapInPandas(lines, "hash long, line string").groupBy("hash").agg(F.first("line").alias("line"))
        counted = once.select("line").mapInPandas(count_bigrams, "p string, c string, n long")
        grams = [tuple(r) for r in counted.groupBy("p", "c").agg(F.sum("n").alias("n")).collect()]
    return grams


def mojibake(texts: DataFrame, restore: bool = True) -> DataFrame:
    """Garbled rows of ``texts`` (src, rec_id, text): src, rec_id, states; with ``restore`` also restorable, restored."""
    rows = texts.select("src", "rec_id", "text").filter(F.col("text").isNotNull())
    runs = written(read_runs(rows))
    grams = texts.sparkSession.sparkContext.broadcast(clean_model(runs))

    def label(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(CleanModel(grams.value))
        for part in parts:
            found = ((src, rec_id, labeller.states(_keys(own))) for src, rec_id, own in zip(part["src"], part["rec_id"], part["runs"]))
            yield pd.DataFrame([(src, rec_id, sorted({STATES[s] for s in path if s})) for src, rec_id, path in found if path is not None], columns=["src", "rec_id", "states"])

    found = runs.select("src", "rec_id", "runs").mapInPandas(label, "src string, rec_id bigint, states array<string>")
    if not restore:
        return found

    def mend(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(CleanModel(grams.value))
        for part in parts:
            both = [labeller.restored(t) or (t, True) for t in part["text"]]
            yield part.drop(columns="text").assign(restorable=[w for _, w in both], restored=[t for t, _ in both])

    kind = "src string, rec_id bigint, states array<string>, restorable boolean, restored string"
    return rows.join(written(found), ["src", "rec_id"]).select("src", "rec_id", "states", "text").mapInPandas(mend, kind)
