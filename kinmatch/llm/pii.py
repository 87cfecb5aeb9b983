"""Personal data: fixed patterns, and spans that a character tagger adds.

The patterns give the base spans of every whole text. The tagger (a
bidirectional LSTM with CRF transitions, see ``char_tagger``) is trained from
generated texts with labelled spans, among them forms that the patterns miss:
spelled-out addresses, numbers without a plus, other separators. Every text is
cut into overlapping windows; each window is decoded, pieces of one kind that
meet across windows are joined, and where kinds contradict each other the set of
spans of largest total score is kept for the whole text. Added spans never touch
a base span.

Defined results: a null or empty text has no spans; the patterns take time in
proportion to the text, however long; positions count code points, ends are
exclusive; repeated rows give repeated results; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import char_tagger as ct
from kinmatch.llm import textkernel as tk
from kinmatch.llm.shared import narrowed, tidy

Span = tuple[int, int, str]  # start, end, kind
KINDS = ct.KINDS
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

# The base patterns' parts.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Every match holds one @: look at each of them once instead of at every possible beginning."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        else:
            done = max(done, at)  # what stands before this @ can't begin a later match
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for run in _NUMBERS.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end, "ip"
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.start(), m.end(), "phone"


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += emails(text)
    out += ips(text)
    out += cards(text)
    if "+" in text:
        out += phones(text)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# training texts


@dataclass(frozen=True)
class Recipe:
    """How many generated windows the tagger is trained on, and how long they are."""

    windows: int = 4000
    length: int = 96
    seed: int = 17


_SYLLABLES = "the and ing tion er on at en re th in es or ti an he nd ed ha st ou ea nt of is it to le la de que los ción ment aux ier ch sch ung keit ä ö é ñ el en un das die be ge zu ro mi co na ra".split()
_SMALL = "at a do to de la ado dot co o atat doto com org net the dos mat hat".split()
_NAMES = "ana ben carla dora emil franz gina hugo ines jon karl lena mara nils olga paul rita sam tina ute vera will".split()
_HOSTS = "mail example post corp shop uni home inbox web net acme".split()
_TLDS = "com org net de fr es io co.uk edu".split()


def _word(r: random.Random) -> str:
    """Made-up words of any letters, some of common syllables, and small words that spelled-out addresses share."""
    if r.random() < 0.12:
        return r.choice(_SMALL)
    if r.random() < 0.5:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randrange(1, 5)))
    return "".join(r.choice("aaeeeiiooutttnnsshhrrddlllccmmwwffggyyppbbvvkjxqzéèêñóíüöäßçâ") for _ in range(r.randrange(1, 12)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(str(r.randrange(10)) for _ in range(n))


def _card_digits(r: random.Random) -> str:
    d = r.choice("3456") + _digits(r, 14)
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


def _personal(r: random.Random) -> tuple[str, str]:
    """A piece of personal data in one of many forms, and its kind."""
    kind = r.choice(KINDS)
    if kind == "email":
        user = r.choice(_NAMES) + r.choice(["", ".", "_", "-"]) + r.choice([*_NAMES, _digits(r, 2), _word(r)])
        user = r.choice([user, f"{_word(r)}.{_digits(r, 2)}", _word(r)])
        host, tld = r.choice([*_HOSTS, _word(r)]) + r.choice(["", "", str(r.randrange(9))]) + r.choice(["", "", ".example", f".{_word(r)}"]), r.choice(_TLDS)
        form = r.choice(["{u}@{h}.{t}", "{u}@{h}.{t}", "{u}@{h}.{t}", "{u} at {h} dot {t}", "{u} [at] {h} [dot] {t}", "{u}(at){h}(dot){t}", "{u} @ {h}.{t}", "{u}[at]{h}.{t}", "{u} AT {h} DOT {t}"])
        return form.format(u=user, h=host, t=tld), kind
    if kind == "ip":
        sep = r.choice([".", ".", ".", "[.]", "(.)", " . "])
        return sep.join(str(r.randrange(256)) for _ in range(4)), kind
    if kind == "card":
        d = _card_digits(r)
        sep = r.choice(["", "", " ", "-", ".", "/", "  "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4)), kind
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    form = r.choice(["+{n} ({a}) {b}-{c}", "+{n} {a} {b} {c}", "({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "00{n} {a} {b} {c}", "({a}) {b} {c}", "tel {a} {b} {c}"])
    return form.format(n=r.randrange(1, 99), a=a, b=b, c=c), kind


def _harmless(r: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    pick = r.randrange(14)
    if pick == 0:
        return f"20{_digits(r, 2)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"
    if pick == 1:
        return f"{r.randrange(24):02d}:{_digits(r, 2)}"
    if pick == 2:
        return f"version {r.randrange(9)}.{r.randrange(20)}" + r.choice(["", ".", f".{r.randrange(9)}"])
    if pick == 3:
        return f"{r.choice('$€£')}{_digits(r, r.randrange(1, 5))}.{_digits(r, 2)}"
    if pick == 4:
        return "".join(r.choice("0123456789abcdef") for _ in range(40))
    if pick == 5:
        return _digits(r, r.choice([1, 2, 3, 4, 5, 6, 8, 21, 24, 32]))
    if pick == 6:
        return f"{_word(r)}.{_word(r)}"
    if pick == 7:
        return f"http://{_word(r)}.example.{r.choice(_TLDS)}/{_word(r)}?page={_digits(r, 2)}"
    if pick == 8:
        return f"{_word(r)}{r.choice(['%%%', '$$$', '###', '&&&', '***', '!!'])}"
    if pick == 9:
        return f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"'
    if pick == 10:
        return f"{_digits(r, 2)}.{_digits(r, 3)},{_digits(r, 2)}"
    if pick == 11:
        return r.choice(["look at the", "meet at", "dot and dash", "@", "at home", "connect the dots", "(see at)", "+", "- -", "( )", "c++"])
    if pick == 12:
        return f"{_digits(r, 1)}.{_digits(r, 1)}.{_digits(r, 1)}"
    return f"{_digits(r, r.randrange(1, 3))}/{_digits(r, r.randrange(1, 4))}"


def labelled_windows(p: Recipe) -> tuple[np.ndarray, np.ndarray]:
    """Classes and labels (windows, length) of generated texts; pieces cut by a window's edge stay labelled."""
    r = random.Random(p.seed)
    xs, ys = np.zeros((p.windows, p.length), np.int64), np.zeros((p.windows, p.length), np.int64)
    for w in range(p.windows):
        text, labels = "", []
        skip = r.randrange(0, 40)
        while len(text) < p.length + skip:
            roll = r.random()
            part, kind = (*_personal(r),) if roll < 0.13 else (_harmless(r), "") if roll < 0.25 else (_word(r), "")
            if r.random() < 0.15:
                part = part.upper() if r.random() < 0.3 else part[:1].upper() + part[1:]
            text += part
            labels += [KINDS.index(kind) + 1 if kind else 0] * len(part)
            end = r.choice([" ", " ", " ", " ", ", ", ". ", "\n", ".\n", "### ", "$$$ ", "%%% "])
            text += end
            labels += [0] * len(end)
        n = p.length if r.random() < 0.8 else r.randrange(8, p.length)
        xs[w, :n] = ct.classes_of(np.frombuffer(text[skip : skip + n].encode(), np.uint8))
        ys[w, :n] = labels[skip : skip + n]
    return xs, ys


@functools.lru_cache(maxsize=4)
def trained(recipe: Recipe = Recipe(), training: ct.Training = ct.Training()) -> ct.Tagger:
    """The tagger, trained on this machine; the same arguments give the same weights."""
    tagger = ct.Tagger(training.hidden, training.seed)
    tagger.fit(*labelled_windows(recipe), training)
    return tagger


# application


@dataclass(frozen=True)
class Windows:
    length: int = 256
    overlap: int = 64
    #: windows that run side by side
    batch: int = 1024
    #: an added span's least log odds against no span, and least length
    least_odds: float = 0.0
    least_length: int = 7
    most_length: int = 80


def tagged(w: dict[str, np.ndarray], classes: np.ndarray, bounds: np.ndarray, p: Windows) -> list[list[tuple[int, int, int, float]]]:
    """For each text (classes[bounds[d]:bounds[d + 1]]) its decoded pieces: (start, end, label, score)."""
    size = np.diff(bounds)
    step = p.length - p.overlap
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - p.length) // step)), 0)
    owner = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * step
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in size]
    for lo in range(0, len(owner), p.batch):
        own, first = owner[lo : lo + p.batch], start[lo : lo + p.batch]
        place = first[None, :] + np.arange(p.length)[:, None]
        inside = place < size[own]
        x = np.where(inside, classes[np.minimum(bounds[own] + place, len(classes) - 1)], ct.PAD)
        e = ct.emissions(w, x)
        some = ct.undecided(w, e)
        if not len(some):
            continue
        e = np.ascontiguousarray(e[:, :, some])
        labels = ct.viterbi(w, e)
        labels[~inside[:, some]] = 0
        edge = np.zeros((1, len(some)), np.int8)
        turn = np.diff(np.concatenate([edge, labels, edge]), axis=0) != 0
        for k in np.flatnonzero(labels.any(axis=0)):
            at = np.flatnonzero(turn[:, k])
            at = np.union1d(at, [0, p.length])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                label = int(labels[a, k])
                if label:
                    s = int(first[some[k]])
                    found[own[some[k]]].append((s + a, s + b, label, ct.log_odds(w, e, a, b, label, int(k))))
    return found


def reconciled(pieces: list[tuple[int, int, int, float]], p: Windows) -> list[tuple[int, int, int, float]]:
    """Pieces of one label that overlap become one span; of spans that contradict each other the set of largest score stays."""
    joined: list[tuple[int, int, int, float]] = []
    for label in range(1, ct.N_LABELS):
        own = sorted(x for x in pieces if x[2] == label)
        for a, b, _, score in own:
            if joined and joined[-1][2] == label and a < joined[-1][1]:
                s, t, _, before = joined[-1]
                joined[-1] = (s, max(t, b), label, max(before, score))
            else:
                joined.append((a, b, label, score))
    spans = sorted((x for x in joined if x[3] >= p.least_odds and x[1] - x[0] >= p.least_length), key=lambda x: x[1])
    best, take = [0.0], []
    ends = [x[1] for x in spans]
    for i, (a, _, _, score) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], a, side="right"))
        take.append(best[j] + score > best[i])
        best.append(max(best[i], best[j] + score))
    out, i = [], len(spans)
    while i:
        if take[i - 1]:
            out.append(spans[i - 1])
            i = int(np.searchsorted(ends[: i - 1], spans[i - 1][0], side="right"))
        else:
            i -= 1
    return out[::-1]


# What an added span must hold.
_SPELLED = re.compile(r"(?is)^.*?\w.*?(?:@|\bat\b).*?\w.*(?:\.|\bdot\b)\W*[^\W\d_]{2,}$")


def plausible(text: str, label: int) -> bool:
    """An exact check of an added span: an address needs its at and dot, an ip four numbers, a card its check digit."""
    kind = KINDS[label - 1]
    if kind == "email":
        return bool(_SPELLED.match(text))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    digits = re.sub("[^0-9]", "", text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def added_spans(text: str, pieces: list[tuple[int, int, int, float]], base: list[Span], p: Windows) -> list[Span]:
    """The tagger's spans, without white space and punctuation at their ends, that are plausible and touch no base span."""
    out = []
    for a, b, label, _ in reconciled(pieces, p) if pieces else []:
        while a < b and not text[a].isalnum() and text[a] not in "+(":
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if p.least_length <= b - a <= p.most_length and plausible(text[a:b], label) and not any(s < b and a < t for s, t, _ in base):
            out.append((a, b, KINDS[label - 1]))
    return out


def personal_data(docs: DataFrame, tagger: ct.Tagger | None = None, windows: Windows = Windows(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: counts of base spans, their digest, and all spans as kind:start:end."""
    tagger = trained() if tagger is None else tagger
    sent = docs.sparkSession.sparkContext.broadcast(tagger.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for first, data, offsets in tk.chunks(batch.column(1)):
                n = len(offsets) - 1
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                pieces = tagged(w, ct.classes_of(data), points[offsets], windows)
                raw = data.tobytes()
                counts, digests, spans, more = np.zeros((4, n), np.int64), [], [], []
                for d in range(n):
                    text = raw[offsets[d] : offsets[d + 1]].decode()
                    base = base_spans(text)
                    for _, _, kind in base:
                        counts[KINDS.index(kind), d] += 1
                    new = added_spans(text, pieces[d], base, windows)
                    digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                    spans.append(written(sorted([*base, *new], key=lambda s: (s[0], KINDS.index(s[2])))))
                    more.append(len(new))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return narrowed(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
