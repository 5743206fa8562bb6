"""Template residue, filler and error pages: a regularised linear classifier on hashed n-grams of lines.

Features of a line: hashed words and word pairs (lower case, numbers and hexadecimal codes as one symbol each), its first word
and first pair, hashed shapes of words with markup signs (exact, and coarse with all signs as one), its length class, and title
features (first line of its text, the only line beside the title).
Weak labels: phrases and placeholder signs vote for residue, unless they stand in quotes or inside a longer sentence that
writes about them (such lines vote against with five times the weight); in pages, the last line of a text of at most three lines
under an error status votes for residue too, with a tenth of the weight; all other lines vote against. A logistic regression
with L2 penalty is fitted on a bounded sample of labelled lines (``bound`` a class). Labels are used for nothing else: every
line of every text is scored by the model alone. The least score is set by F1 on the lines of hosts that a model
fitted on the other hosts has not seen. A text is residue if one of its lines is.

Defined cases: null texts give no row; empty texts are no residue; pages without any visible text are judged by their notices
for readers without scripts; empty tables give no rows; without a labelled line of either class nothing is residue; rows without
url are a host each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.markup import notice_lines, shown_lines
from adlens.session import written

BITS = 18
#: Times that a sign's coarse shape counts, so that one sign in a long line is not outweighed by its words.
COARSE = 4
DIM = 1 << BITS
#: Most labelled lines of a class that the classifier is fitted on.
BOUND = 40_000
#: Every FOLDS-th host is held out to set the least score.
FOLDS = 5
#: What the least score may cost of the best F1 on those hosts.
F1_LOSS = 0.01
#: Lines with template signs are sampled so many times as often as others, for few of them are residue.
SIGNED = 10
#: Weights of lines that write about residue, and of lines that only a status votes for.
ABOUT_WEIGHT, STATUS_WEIGHT = 5.0, 0.1

#: Signs of unfilled templates.
SIGNS = (
    r"\{\{\s*[\w .]+\}\}", r"\[\[\s*[\w ]+\]\]", r"%%\w+%%", r"@@\w+@@", r"(?<![\w%])%[^\W\d][^\W\d]{2,}%", r"\$\{\s*\w+\s*\}", r"#\{\s*\w+\s*\}", r"<%=?\s*[\w.]+\s*%>", r"\{%\s*\w+\s*%\}",
    r"(?<!\w)__[^\W\d_]\w*__(?!\w)", r"\[(?i:insert|wstaw|ins[ée]rer|ins[ée]rez|einf[üu]gen|hier)\b[^\]]*\]", r"\{(?i:keyword):[^}]*\}", r"&lt;\w+&gt;|<[a-z]+_[a-z_]+>",
)
#: A sign that is named and quoted is written about.
QUOTED = re.compile(r"(?i)(?:tag|placeholder|platzhalter|variable|znacznik|balise|code|macro|makro|field|feld|pole|champ)\W{0,3}[“„\"«‚'‘(]\s*$")
#: First words of filler.
FILLER = (
    r"lorem (?:ipsum|lorem)\b(?: \w+){4}|lorem(?: \w+){12}", "sample headline", "dummy (?:text|paragraph)", "placeholder text", "(?:text goes|your text) here", "replace before launch", r"coming soon\b.*\bcopy",
    "tu wpisz", "przykładowy nagłówek", "tekst zastępczy do", "opis w przygotowaniu", "beschreibung folgt", "hier steht ihr text", "hier (?:kommt|folgt) ", "musterüberschrift|beispielüberschrift", "platzhaltertext|blindtext f",
    "texte? à (?:venir|remplacer)", "votre texte ici", "titre d.exemple", "faux texte", "description à venir", "saisissez votre texte", "bientôt en ligne",
)
#: First words of error messages and of notices that scripts, a session or a check are required.
FAILURE = (
    r"(?:error|fehler|błąd|erreur) \d{3}\b", r"[45]\d\d\b.{0,3}(?:page not found|bad gateway|not found|forbidden|internal server|service|gateway|too many)", "internal server error|too many requests", "access denied", "zugriff verweigert", "brak dostępu", "accès refusé",
    "interner serverfehler", "wewnętrzny błąd serwera", "erreur interne du serveur", "service (?:temporarily|momentanément)", "dienst vorübergehend", "serwis chwilowo", r"(?:oops|ups|hoppla|oups)\b.{0,3}(?:this|tej|diese|cette)\b", "something went wrong on", "sorry, we can.t find", "coś poszło nie tak", "etwas ist schiefgelaufen", "une erreur s.est produite",
    r"sqlstate\[", r"traceback \(most recent", "warning: undefined variable", "fatal error:", "upstream connect error", r"\{\"error\":", r"keyerror:|\w*exception in thread",
    "please enable javascript", "bitte aktivieren sie javascript", "veuillez activer javascript", "aby kontynuować, włącz", "this site needs scripts", "ohne skripte lässt", "cette page a besoin de scripts", "strona wymaga skryptów",
    "your session has expired", "ihre sitzung ist abgelaufen", "votre session a expiré", "twoja sesja wygasła", "checking that you are not", "sprawdzamy, czy nie jesteś", "wir prüfen (?:kurz, )?ob sie", "nous vérifions que vous|vérification (?:en cours|que vous)",
)
#: Texts that write about residue use these words away from the start of a line.
ABOUT = re.compile(r"(?i).\b(?:lorem ipsum|javascript|internal server error|404|placeholder|platzhalter|blindtext|tekst zastępczy|error page|skrypt|scripts?)\b|\bKeyWord:|%%|\{\{|\[\[")
#: Words of the usual filler text; a line with three of them at a tenth of its words or more is filler.
LATIN = re.compile(r"(?i)\b(?:lorem|ipsum|dolor|amet)\b")
#: All that votes: signs anywhere, phrases at the start of a line, and the words of filler.
VOTERS = (*SIGNS, *FILLER, *FAILURE, LATIN.pattern)

PLACEHOLDER = re.compile("|".join(SIGNS))
PHRASE = re.compile(rf"(?i)^\W*(?:{'|'.join(FILLER + FAILURE)})")
_CODE = r"\b[0-9a-f]*[0-9][0-9a-f]{6,}\b"


def _is_latin(line: str) -> bool:
    n = len(LATIN.findall(line)) if "r" in line and len(line) > 14 else 0
    return n >= 3 and 10 * n >= line.count(" ") + 1


_SIGNS = re.compile(r"[{}\[\]%$<>_#&@]")
_RARE_SIGNS = r"[{}\[\]<>_#@]|%%"
#: Lines that may vote either way, in a form that is matched over whole columns; all others need no closer look.
_MAY_VOTE = (
    r"(?i)\{\{|\[\[|%%|@@|%\pL|[$#]\{|<%|\{%|__|\[(?:insert|wstaw|ins[ée]r|einf|hier)|\{keyword:|&lt;|<[a-z]+_|lorem|ipsum|dolor|amet|javascript|internal server error|404|placeholder|platzhalter|blindtext|tekst zast|error page|skrypt|script|keyword:"
    rf"|^[^\pL\pN]*(?:{'|'.join(FILLER + FAILURE)})".replace(r"\w", r"\S")
)
#: First letters of the phrases; most lines begin with none of them and need no closer look.
_FIRST = frozenset("lsdptyrcohbmeéfvidnwzauk{45")


def residue_vote(line: str) -> bool:
    """Whether the phrases and signs vote for residue. Votes label lines for the classifier and decide nothing else."""
    if _SIGNS.search(line):
        m = PLACEHOLDER.search(line)
        if m:
            return not QUOTED.search(line[: m.start()])
    head = line.lstrip(" -–·>*#\"'„“«")[:1].lower()
    return (head in _FIRST and bool(PHRASE.match(line))) or _is_latin(line)


def voter(line: str) -> int:
    """Place in ``VOTERS`` of the sign or phrase that votes for residue in ``line``, -1 for none."""
    if not residue_vote(line):
        return -1
    for i, sign in enumerate(SIGNS):
        if re.search(sign, line):
            return i
    for i, phrase in enumerate(FILLER + FAILURE):
        if re.match(rf"(?i)^\W*(?:{phrase})", line):
            return len(SIGNS) + i
    return len(VOTERS) - 1


def record_lines(src: str, text: str) -> list[str]:
    if src != "pages":
        return [s for x in text.split("\n") if (s := x.strip())]
    shown = [x for x in shown_lines(text) if x]
    return shown or notice_lines(text)


def _coarse(word: str) -> str:
    """Shape of a word with all markup signs as one, so that a sign never seen before resembles the others."""
    return re.sub(r"[^\W_](?:\w*[^\W_])?", "a", re.sub(r"(?:[{}\[\]%$<>#@]|&(?:lt|gt);|_(?=[_\W]|$)|(?<![^\W_])_)+", "+", word)).rstrip(".,;:!?")


def features(lines: pa.Array, first: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line number, feature) pairs; every unique word is hashed once."""
    low = pc.utf8_lower(lines)
    low = pc.replace_substring_regex(pc.replace_substring_regex(low, _CODE, "h"), r"\d+", "0")
    words = pc.utf8_split_whitespace(low)
    lengths = np.asarray(pc.list_value_length(words).fill_null(0))
    flat = words.flatten().dictionary_encode()
    unique = flat.dictionary.to_pylist()
    plain = [w.strip(".,;:!?()…") or w for w in unique]
    ids = pd.util.hash_array(np.array(plain, object), categorize=False) if unique else np.zeros(0, np.uint64)
    signed = [_SIGNS.search(w) is not None and len(w) > 1 for w in unique]
    shapes = np.array([hash_text("§" + re.sub(r"[^\W\d_]+", "a", w)) if x else 0 for w, x in zip(unique, signed)], np.uint64)
    coarse = np.array([hash_text("¤" + _coarse(w)) if x else 0 for w, x in zip(unique, signed)], np.uint64)
    at = np.asarray(flat.indices)
    word, row = ids[at], np.repeat(np.arange(len(lines)), lengths)
    pair = row[1:] == row[:-1]
    pairs = (word[:-1][pair] * np.uint64(0x9E3779B97F4A7C15)) ^ (word[1:][pair] + np.uint64(77))
    shape = shapes[at]
    starts = np.flatnonzero(np.r_[True, ~pair])[: len(row)] if len(row) else np.zeros(0, np.int64)  # a line's first word
    followed = starts[starts + 1 < len(row)]
    followed = followed[row[followed] == row[followed + 1]]
    opening = (word[followed] ^ np.uint64(0xA5A5A5A5)) * np.uint64(0xD6E8FEB86659FD93) ^ word[followed + 1]
    rows = [row[starts], row[followed], row, row[:-1][pair], row[shape > 0], np.repeat(row[shape > 0], COARSE), np.arange(len(lines)), np.flatnonzero(first), np.flatnonzero(alone)]
    size = np.minimum(np.log2(lengths + 1).astype(np.uint64), np.uint64(9))
    feats = [word[starts] ^ np.uint64(0x5BD1E995), opening, word, pairs, shape[shape > 0], np.repeat(coarse[at][shape > 0], COARSE), size + np.uint64(1000), np.full(int(first.sum()), 1), np.full(int(alone.sum()), 2)]
    mix = np.concatenate([f.astype(np.uint64) for f in feats])
    mix ^= mix >> np.uint64(29)
    return np.concatenate(rows), ((mix * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def hash_text(text: str) -> int:
    return int(pd.util.hash_array(np.array([text], object), categorize=False)[0])


def _flat(src: list[str], texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines as one column, with the number of their text, whether they are its first, and whether it has at most two."""
    src = np.array(src, object)
    marked = src == "pages"
    own = [record_lines("pages", t) for t, m in zip(texts, marked) if m]
    plain = pc.split_pattern(pa.array([t for t, m in zip(texts, marked) if not m], pa.large_string()), "\n")
    cut = pc.utf8_trim_whitespace(plain.flatten())
    lengths = np.asarray(pc.list_value_length(plain))
    record = np.repeat(np.flatnonzero(~marked), lengths)
    shown = pc.not_equal(cut, "")
    record, cut = record[np.asarray(shown)], cut.filter(shown)
    lines = pa.concat_arrays([pa.array([x for o in own for x in o], pa.large_string()), cut])
    record = np.concatenate([np.repeat(np.flatnonzero(marked), [len(o) for o in own]), record]).astype(np.int64)
    first = np.r_[True, record[1:] != record[:-1]][: len(record)]
    alone = np.bincount(record, minlength=len(src))[record] <= 2
    return lines, record, first, alone


def _host_fold(rows: DataFrame) -> Column:
    """0 to FOLDS - 1, by host; rows without url are a host each."""
    url = F.col("url") if "url" in rows.columns else F.lit(None).cast("string")
    return F.pmod(F.xxhash64(F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.concat("src", F.col("rec_id").cast("string")))), F.lit(FOLDS)).cast("int")


def labelled_lines(rows: DataFrame, bound: int = BOUND) -> pd.DataFrame:
    """At most ``bound`` distinct lines of each class: line, first, alone, label, weight, n, unseen (times on held-out hosts), stands_for."""
    rows = rows.filter(F.col("text").isNotNull())
    many = max(1, rows.count())
    rate = min(1.0, 4 * bound / (15 * many))
    columns = ["line", "first", "alone", "label", "weight", "fold", "stands_for"]

    def label(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), 2000):
                own = part.iloc[a : a + 2000]
                lines, record, first, alone = _flat(own["src"].tolist(), own["text"].tolist())
                last = np.r_[record[1:] != record[:-1], True][: len(record)]
                short = np.bincount(record, minlength=len(own))[record] <= 3
                failed = last & short & ((own["src"] == "pages") & (own["status"] >= 400)).to_numpy()[record]
                at = np.arange(len(record)) - np.maximum.accumulate(np.where(first, np.arange(len(record)), 0))
                chance = np.where(np.asarray(pc.match_substring_regex(lines, _RARE_SIGNS)), min(1.0, SIGNED * rate), rate)
                drawn = pd.util.hash_array((own["rec_id"].to_numpy()[record] * 1_000_003 + at).astype(np.uint64)) < chance * 2.0**64
                may = np.asarray(pc.match_substring_regex(lines, _MAY_VOTE))
                out = []
                for i in np.flatnonzero(drawn | may | failed).tolist():
                    line = lines[i].as_py()
                    vote = bool(may[i]) and residue_vote(line)
                    weight = ABOUT_WEIGHT if may[i] and not vote and ABOUT.search(line) else 1.0
                    stands_for = 1.0
                    if failed[i] and not vote and weight == 1:
                        vote, weight = True, STATUS_WEIGHT
                    elif not vote and weight == 1:
                        if not drawn[i]:
                            continue
                        stands_for = 1 / chance[i]
                    out.append((line, first[i], alone[i], vote, weight, int(own["fold"].iloc[record[i]]), stands_for))
                yield pd.DataFrame(out, columns=columns)

    found = rows.select("src", "rec_id", F.coalesce("status", F.lit(0)).alias("status"), "text", _host_fold(rows).alias("fold"))
    found = found.mapInPandas(label, "line string, first boolean, alone boolean, label boolean, weight double, fold int, stands_for double")
    most = [F.max(c).alias(c) for c in ("first", "alone", "label", "weight", "stands_for")]
    once = written(found.groupBy("line").agg(*most, F.count("*").alias("n"), F.count_if(F.col("fold") == 0).alias("unseen")))
    sides = [once.filter(F.col("label") == side).orderBy(F.desc("weight"), F.desc("n"), F.xxhash64("line"), "line").limit(bound).toPandas() for side in (True, False)]
    return pd.concat(sides, ignore_index=True)


def fit(lines: pd.DataFrame, penalty: float = 1e-4, rounds: int = 200, rate: float = 0.5, against: float = 8.0) -> np.ndarray:
    """Weights (last: intercept) of the logistic regression, by full-batch AdaGrad."""
    row, feat = features(pa.array(lines["line"], pa.large_string()), lines["first"].to_numpy(bool), lines["alone"].to_numpy(bool))
    y = lines["label"].to_numpy(float)
    weight = lines["weight"].to_numpy(float) * np.log2(1 + lines["n"].to_numpy(float))
    share = max(1.0, y.sum()) / len(y)
    weight = weight * np.where(y > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share)) * np.where(y > 0, 1.0, against)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    # Only features that occur have weights; all others stay 0.
    held, feat = np.unique(feat, return_inverse=True)
    w, b, seen, seen_b = np.zeros(len(held)), 0.0, np.full(len(held), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[feat], len(y)) * scale + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gw = np.bincount(feat, (g * scale)[row], len(held)) + penalty * w / DIM * 100
        seen += gw**2
        seen_b += g.sum() ** 2
        w -= rate * gw / np.sqrt(seen)
        b -= rate * g.sum() / np.sqrt(seen_b)
    out = np.zeros(DIM + 1)
    out[held], out[-1] = w, b
    return out


def scores(weights: np.ndarray, lines: pa.Array, first: np.ndarray, alone: np.ndarray) -> np.ndarray:
    if not len(lines):
        return np.zeros(0)
    # Equal lines in equal places are scored once.
    kinds = np.asarray(lines.dictionary_encode().indices).astype(np.int64) * 4 + np.asarray(first, bool) * 2 + np.asarray(alone, bool)
    _, at, same = np.unique(kinds, return_index=True, return_inverse=True)
    row, feat = features(lines.take(pa.array(at)), first[at], alone[at])
    n = np.bincount(row, minlength=len(at))
    return (np.bincount(row, weights[feat], len(at)) / np.sqrt(np.maximum(n, 1)) + weights[-1])[same]


def _scored(weights: np.ndarray, lines: pd.DataFrame) -> np.ndarray:
    return scores(weights, pa.array(lines["line"], pa.large_string()), lines["first"].to_numpy(bool), lines["alone"].to_numpy(bool))


def least_score(z: np.ndarray, label: np.ndarray, stands_for: np.ndarray) -> float:
    """The greatest least score whose F1 is within ``F1_LOSS`` of the best; sampled lines count for all they stand for.

    The model in use is fitted on all hosts and sure of more, so that among cuts that are as good here the strictest one is best there.
    """
    order = np.argsort(-z, kind="stable")
    z, label = z[order], label[order]
    right, wrong = np.cumsum(label), np.cumsum(np.where(label, 0.0, stands_for[order]))
    ends = np.r_[z[1:] != z[:-1], True]
    f1 = np.where(ends, 2 * right / (right + wrong + right[-1]), 0)
    at = int(np.flatnonzero(f1 >= f1.max() - F1_LOSS)[0])
    return float(z[at]) - 1e-9


def _fitted(lines: pd.DataFrame) -> np.ndarray | None:
    """Weights whose intercept makes 0 the least score."""
    if lines["label"].nunique() < 2:
        return None
    weights = fit(lines)
    known, unseen = lines[lines["n"] > lines["unseen"]], lines[(lines["unseen"] > 0) & ((lines["weight"] >= 1) | ~lines["label"])]
    if known["label"].nunique() == 2 and unseen["label"].nunique() == 2:
        judged = fit(known.assign(n=known["n"] - known["unseen"]))
    else:  # too few hosts to hold any out
        judged, unseen = weights, lines
    least = least_score(_scored(judged, unseen), unseen["label"].to_numpy(bool), unseen["stands_for"].to_numpy(float))
    weights[-1] -= least
    return weights


def trained(rows: DataFrame, bound: int = BOUND) -> np.ndarray | None:
    return _fitted(labelled_lines(rows, bound))


def validated(rows: DataFrame, bound: int = BOUND) -> DataFrame:
    """(held_out, positive, found, wrong): what the model finds of the lines that it and its least score were kept from.

    held_out 'hosts': the lines of a fifth of the hosts, the model and its least score being fitted on the others, judged by the votes;
    'voters 0' to 'voters 2': lines for which a third of the phrases and signs vote, left out of the labels. ``wrong`` counts lines
    that nothing votes for, each for as many as it stands for. Lines that only a status votes for are left out of the judgement.
    """
    lines = labelled_lines(rows, bound)
    out = []

    def judge(name: str, weights: np.ndarray | None, judged: pd.DataFrame) -> None:
        if weights is not None and len(judged):
            found, label = _scored(weights, judged) > 0, judged["label"].to_numpy(bool)
            out.append((name, int(label.sum()), int((found & label).sum()), float(judged["stands_for"].to_numpy(float)[found & ~label].sum())))

    sure = (lines["weight"] >= 1) | ~lines["label"]
    known = lines[lines["n"] > lines["unseen"]]
    known = known.assign(n=known["n"] - known["unseen"])
    # Of the hosts that are left, lines with an odd hash set the least score.
    known = known.assign(unseen=np.where(pd.util.hash_array(known["line"].to_numpy(object)) % FOLDS == 0, known["n"], 0))
    judge("hosts", _fitted(known), lines[(lines["unseen"] > 0) & sure])
    by = np.array([voter(x) if v else -1 for x, v in zip(lines["line"], lines["label"])], np.int64)
    for third in range(3):
        held = (by >= 0) & (by % 3 == third)
        judge(f"voters {third}", _fitted(lines[~held]), lines[(held | ~lines["label"]) & sure])
    return rows.sparkSession.createDataFrame(out, "held_out string, positive bigint, found bigint, wrong double")


def residue(rows: DataFrame, bound: int = BOUND, weights: np.ndarray | None = None) -> DataFrame:
    """(src, rec_id, score, line): the rows (src, rec_id, status, text, url) that are residue, with their most telling line."""
    columns = ["src", "rec_id", "status", "text", *(["url"] if "url" in rows.columns else [])]
    rows = rows.filter(F.col("text").isNotNull()).select(*columns)
    weights = trained(rows, bound) if weights is None else weights
    kind = "src string, rec_id bigint, score double, line string"
    if weights is None:
        return rows.sparkSession.createDataFrame([], kind)
    shared = rows.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for part in parts:
            for a in range(0, len(part), 2000):
                own = part.iloc[a : a + 2000]
                lines, record, first, alone = _flat(own["src"].tolist(), own["text"].tolist())
                z = scores(w, lines, first, alone)
                best: dict[int, int] = {}
                for i in np.flatnonzero(z > 0).tolist():
                    r = int(record[i])
                    if r not in best or z[i] > z[best[r]]:
                        best[r] = i
                src, ids = own["src"].tolist(), own["rec_id"].tolist()
                yield pd.DataFrame([(src[r], ids[r], float(z[i]), lines[i].as_py()) for r, i in best.items()], columns=["src", "rec_id", "score", "line"])

    return rows.select("src", "rec_id", "text").mapInPandas(judge, kind)
