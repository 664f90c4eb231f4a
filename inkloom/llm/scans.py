"""Noise in text from scanned pages.

One pass over the texts finds page furniture, broken words and the words they
are made of. Boosted trees over a line and the one after it decide which lines
are running headers and page numbers, and which hyphens at line ends break a
word. Words are counted, correction candidates are retrieved by joins over an
inverted list of character q-grams, and boosted trees rank them.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from inkloom.llm.boosting import Boosted
from inkloom.session import broadcast_if_small, cut_lineage

# What a scanner reads for what is printed, as "read printed".
CONFUSIONS = [
    tuple(x.split(" "))
    for x in (
        "0 o,1 l,5 s,9 g,6 b,! i,8 b,| l,rn m,m rn,in m,m in,ri n,n ri,ii u,u ii,vv w,w vv,cl d,d cl,c e,e c,h b,b h,f t,t f,a o,o a,"
        "l i,i l,1 i,li h,h li,nn m,ni m,m ni,q g,g q,y v,v y,u v,v u,n h,h n,n u,u n,i !,tl d,fi h,iii m,ln m,k lc,j i,i j"
    ).split(",")
]
#: Texts from which the labelled lines of the furniture classifier are taken, and candidates for the words counted without their book.
SAMPLE_ROWS = 8_000
#: A word is common that occurs once in so many texts, in lower case at least one time in five; how much more often than
#: that it must occur in the sample to be counted without its book.
COMMON_TEXTS, COMMON_SMALL, COMMON_MARGIN = 100, 0.2, 1.5
#: Labelled pairs the rankers are fitted on.
SAMPLE_PAIRS = 6_000
#: How much more often the right word must occur than the wrong one, in the corpus and in one book.
RATIO, BOOK_RATIO = 20, 4
#: Times from which a capitalised word of one book is a name of it.
NAME_TIMES = 6
#: A word, with hyphens and with marks that stand for letters inside it, at its start, or (a bar) at its end.
_TOKEN = re.compile(r"(?:[!|](?<![^\s\"“”‘’'(\[][!|])(?=[^\W\d_]))?[^\W_]+(?:[!|][^\W\d_]+|-[^\W\d_]+)*(?:\|(?<=[^\W\d_]\|)(?=[\"”’'.,;:!?)\]]*(?:\s|\Z)))?")
#: The same where no mark stands before a letter and there is no bar.
_PLAIN_TOKEN, _JOINED_MARK = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*"), re.compile(r"[!|][^\W\d_]|\|")
#: A hyphen at what is or was a line end, and the ends of the words beside it.
_BREAK = re.compile(r"-(?:[ \t]*\n\s*|[ \t]+)(?=[^\W\d_])")
_LEFT = re.compile(r"[^\W_]+(?:[!|][^\W_]+)*$")
_DIGITS = r"(?:[0-9lOoIS]{0,3}[0-9][0-9lOoIS]{0,3}|l{1,2}|[lO]{2})"
_ROMAN = r"(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_DECOR = r"[^A-Za-z0-9.,;:!?\n]{0,8}"
_NUMBER_LINE = re.compile(rf"{_DECOR}(?:(?:page|p\.|pg\.?)\s*)?({_DIGITS}|{_ROMAN}){_DECOR}", re.I)
_NUMBER_BESIDE = re.compile(rf"\s*(?:({_DIGITS}|{_ROMAN})\s{{2,}}(?P<after>\S.*)|(?P<before>\S.*?)\s{{2,}}({_DIGITS}|{_ROMAN}))\s*")

_NAME_PART = r"[^\W\da-z_]{2,}+(?:['’.-][^\W\da-z_]++)*+"
_CAPITALS = re.compile(rf"\s*(?:\d+\s{{2,}})?{_NAME_PART}(?: {_NAME_PART})+(?:\s{{2,}}\d+)?\s*")
_HEADING = re.compile(r"\s*(?:chapter|part|book)\b", re.I)

_KEEP = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(ord("0"), ord("9") + 1))
_FROM, _TO = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ01!|5896", b"abcdefghijklmnopqrstuvwxyzoliisbgb"
_CLASSES = bytes.maketrans(b"cehbftaoil", b"eebbeeooii")
_FOLD = bytes.maketrans(_FROM, _TO)
_DROP = bytes(b for b in range(256) if b not in _KEEP and b not in _FROM)
_GROUPS = ((b"vv", b"w"), (b"ii", b"u"), (b"rn", b"m"), (b"in", b"m"), (b"ri", b"n"), (b"cl", b"d"))


_DROP_WITHIN = _DROP.replace(b"\n", b"")


def scan_skeleton(text: str) -> bytes:
    """A text with all that a scanner confuses made equal, without blanks, marks and accented letters."""
    return _grouped(text.encode("ascii", "ignore").translate(_FOLD, _DROP))


def _grouped(out: bytes) -> bytes:
    for read, printed in _GROUPS:
        out = out.replace(read, printed)
    return out.translate(_CLASSES)


@lru_cache(maxsize=4096)
def _cores_of(names: tuple[str | None, ...]) -> tuple[bytes, ...]:
    """Skeletons to look for, without the ends, which what stands beside them may have changed."""
    return tuple(core for name in names if name and len(core := scan_skeleton(name)[1:-1]) >= 5)


#: One short token with any ornaments: what a page number may look like.
_MAYBE_NUMBER = re.compile(r"^[^A-Za-z0-9\n]*(?:(?:page|p\.|pg\.?)[^A-Za-z0-9\n]*)?[A-Za-z0-9]{1,8}[^A-Za-z0-9\n]*$", re.I | re.M)
#: A line without small letters.
_MAYBE_CAPITALS = re.compile(r"^(?=.*[^\W\d_])[^a-z\n]+$", re.M)
_TITLED = re.compile(r"\s*(?:chapter|part|book|prologue|epilogue|\w+ \W|\d)", re.I)


class _Lines:
    """A text as lines, with what tells furniture from prose: a line that may be furniture, and the line after it.

    ``found`` has the number and features of each such line.  Lines are looked
    for in the text as a whole; a text without any isn't taken apart.
    """

    def __init__(self, text: str, names: list[str | None]) -> None:
        self.cores = _cores_of(tuple(names))
        self.nameless = len(names) < 2 or not names[0] or not names[1]
        folded = text.encode("ascii", "ignore").translate(_FOLD, _DROP_WITHIN) if self.cores else b""
        whole = _grouped(folded.replace(b"\n", b""))
        self.has_core = any(core in whole for core in self.cores)
        self.found: list[tuple[int, list[float]]] = []
        self.capital = {text.count("\n", 0, m.start()) for m in _MAYBE_CAPITALS.finditer(text) if m[0].isupper()}
        short = {text.count("\n", 0, m.start()) for m in _MAYBE_NUMBER.finditer(text)}
        if not (self.has_core or self.capital or short):
            self.lines = [text]
            return
        self.lines = lines = text.split("\n")
        by_line = _grouped(folded).split(b"\n") if self.cores and (self.has_core or self.capital) else []
        skeletons = {i: by_line[i] for i in self.capital} if by_line else {}
        self.parts = {i: s for i, s in skeletons.items() if " " in lines[i].strip() and len(s) >= 5 and any(s[1:-1] in core for core in self.cores)}
        self.hint = self.has_core or any(len(p) >= 10 for p in self.parts.values())
        shown = [i for i, line in enumerate(lines) if line.strip()]
        self.edges = {i: k for k, pair in enumerate(zip(shown[:3], reversed(shown[-3:]))) for i in pair}
        own = {i: by_line[i] for i in shown} if self.hint else {}
        holds = {i for i, s in own.items() if any(c in s for c in self.cores)}
        pairs = set()
        if self.has_core and not holds:
            # A name wrapped over two lines, or over more, where the first line stands for it.
            pairs = {i for i in shown if i + 1 < len(lines) and lines[i + 1] and any(c in scan_skeleton(lines[i] + lines[i + 1]) for c in self.cores)} or set(shown[:1])
        beside = {i for i in own if _NUMBER_BESIDE.fullmatch(lines[i])}
        for i in sorted(short | self.capital | holds | pairs | beside):
            if lines[i].strip():
                self.found.append((i, self._features(i, own.get(i, b""), i in holds, i in pairs)))

    def _features(self, i: int, own: bytes, core: bool, pair: bool) -> list[float]:
        line = self.lines[i]
        after = self.lines[i + 1] if i + 1 < len(self.lines) else ""
        number = _NUMBER_LINE.fullmatch(line) is not None
        beside = _NUMBER_BESIDE.fullmatch(line) if self.hint else None
        rest = _is_header((beside["after"] or beside["before"]), self.cores) if beside else False
        left = own
        for c in self.cores:
            left = left.replace(c, b"")
        return [
            float(number), float(i in self.capital), float(self.nameless and _CAPITALS.fullmatch(line) is not None and not _HEADING.match(line)), float(core), float(pair),
            float(len(self.parts.get(i, b""))), float(len(left)) if core else 99.0, float(beside is not None), float(rest), float(self.nameless), float(self.hint),
            float(_TITLED.match(line) is not None), float(sum(c.isalnum() for c in line)), float(sum(c.isdigit() for c in line)), float(self.edges.get(i, 3)),
            float(not after.strip()), float(after[:1].islower()), float(i > 0 and not self.lines[i - 1].strip()),
        ]


#: What the classifiers tell of a line: it holds a header, it holds a page number, it is nothing but furniture.
_KINDS = ("header", "number", "furniture")


def _labels(x: list[float]) -> tuple[bool, bool, bool]:
    """Labels of a line from its features, by rule; for fitting only."""
    number, capital, capitals, core, pair, part, left, beside, rest, nameless, hint, titled, _, digits = x[:14]
    if number:
        return False, True, True
    if nameless and capitals:
        return True, digits > 0, True
    if hint and rest:
        return True, True, True
    alone = bool(hint and ((core and (left <= 4 or (left <= 24 and titled))) or (not core and part >= 5)))
    return bool(core or pair or part >= 10 or alone), False, alone


def fit_furniture(lines: list[list[float]], names: list[str], seed: int = 5) -> dict[str, Boosted]:
    """Boosted trees over line pairs, one for each of ``_KINDS``.

    Fitted on labelled lines: ``lines``, a bounded sample of those of the texts,
    and as many made from names, numbers and words, so that every shape is known
    however few texts there are.
    """
    rng = np.random.default_rng(seed)
    made, words = [], "a lantern stood by the wall and nobody moved until morning came over the river again".split()
    titles = [n for n in names if n and len(n) > 6] or ["The Lantern by the River", "Morning over the Wall"]
    for _ in range(1_500):
        title, other = (titles[rng.integers(len(titles))] for _ in range(2))
        n = int(rng.integers(1, 900))
        prose = " ".join(words[rng.integers(len(words))] for _ in range(12))
        line = (
            f"{other.upper()} ORLA", f"{n}  {other.upper()} ORLA", f"ORLA {other.upper()}    {n}", title.upper(), f"{title.upper()}    {n}", f"{n}   {title}", f"PART TWO · {title}", title, f"{prose} {title} {prose}", str(n), f"- {n} -", f"Page {n}", "xii", "THREE", f"Chapter {n}", f"{n}.",
            "mix", prose, prose.upper(), f"It took {n} days", other.split()[0], " ".join(title.upper()), other.upper()[: len(other) // 2],
        )[rng.integers(23)]
        for named in ([title, None], [title, other]):
            made += [x for _, x in _Lines(f"{prose}\n{line}\n{prose}", named).found]
    x = np.array(lines + made)
    y = np.array([_labels(row) for row in lines + made], float)
    return {kind: Boosted(trees=40, depth=3).fit(x, y[:, k]) for k, kind in enumerate(_KINDS)}


def _furniture_of(texts: list[tuple[str, list[str | None]]], models: dict[str, Boosted]) -> list[tuple[bool, bool, str]]:
    """For each text whether it holds a running header and a printed page number, and the text without such lines; one scoring for all."""
    parsed = [_Lines(text, names) for text, names in texts]
    x = np.array([f for p in parsed for _, f in p.found]).reshape(-1, 18)
    verdicts = np.column_stack([models[kind].score(x) >= 0.5 for kind in _KINDS]) if len(x) else np.zeros((0, 3), bool)
    out, at = [], 0
    for p, (_, names) in zip(parsed, texts):
        own = verdicts[at : at + len(p.found)]
        at += len(p.found)
        gone = {i for (i, _), v in zip(p.found, own) if v[2]}
        header = bool(own[:, 0].any()) if len(own) else False
        clean = "\n".join(line for i, line in enumerate(p.lines) if i not in gone) if gone else "\n".join(p.lines)
        out.append((header, bool(own[:, 1].any()) if len(own) else False, _without_inline(clean, names) if header else clean))
    return out


def _is_header(line: str, cores: tuple[bytes, ...]) -> bool:
    """Whether a line is hardly more than a name, with a chapter or a second name beside it."""
    have = scan_skeleton(line)
    left = have
    for core in cores:
        left = left.replace(core, b"")
    if len(left) == len(have):
        # A header wrapped over two lines leaves parts of the name on each.
        return len(have) >= 5 and line.isupper() and any(have[1:-1] in core for core in cores)
    return len(left) <= 4 or (len(left) <= 24 and _TITLED.match(line) is not None)


@lru_cache(maxsize=4096)
def _inline_patterns(names: tuple[str | None, ...]) -> list[tuple[str, re.Pattern]]:
    """What to look for in a text in lower case, and the pattern of a name in the middle of a line; a dash joins book and author."""
    book, author = (re.escape(n) if n else None for n in ((*names, None, None))[:2])
    parts = [(names[0], rf"{book}(?:\s+—\s+{author})?" if author else book)] if book else []
    parts += [(names[1], author)] if author else []
    return [(name.lower(), re.compile(rf"(?:(?:chapter|part)\s+\w+\s+·\s+|\b[A-Z]+\s+·\s+)?{part}", re.I)) for name, part in parts]


def _without_inline(text: str, names: list[str | None]) -> str:
    """Without names that stand in the middle of a line."""
    for name, pattern in _inline_patterns(tuple(names)):
        if name in text.lower():
            text = pattern.sub(" ", text)
    return text


def _tokens(text: str) -> list[str]:
    """All words of a text."""
    return (_TOKEN if _JOINED_MARK.search(text) else _PLAIN_TOKEN).findall(text)


def _breaks(text: str) -> list[tuple[int, int, str, str]]:
    """Words broken at a line end: where the hyphen and what follows it begin and end, and both parts in lower case."""
    if "-\n" not in text and "- " not in text and "-\t" not in text:
        return []
    out = []
    for found in _BREAK.finditer(text):
        start, end = found.span()
        if text[end].islower() and (left := _LEFT.search(text, _word_start(text, start), start)):
            out.append((start, end, left[0].lower(), _TOKEN.match(text, end)[0].rstrip("|").partition("-")[0].lower()))
    return out


def _word_start(text: str, end: int) -> int:
    """Where the run of letters, digits and marks that ends at ``end`` begins."""
    at = end
    while at and (text[at - 1].isalnum() or text[at - 1] in "!|"):
        at -= 1
    return at


def _first_pass(common: set[str], models: dict[str, Boosted]):
    """Rows and word counts of a batch; ``common`` are words that are no misreadings and are counted without their book."""
    forms = common | {w.capitalize() for w in common} | {w.upper() for w in common}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, by_book, usual = [], defaultdict(Counter), Counter()
            plain = _furniture_of([(t, [b, a]) for t, b, a in zip(batch["text"], batch["book_name"], batch["author"])], models)
            for (table, key, book), (header, number, clean) in zip(batch[["table_name", "key", "book"]].itertuples(index=False, name=None), plain):
                breaks = _breaks(clean)
                for start, end, _, _ in reversed(breaks):
                    clean = clean[:start] + clean[end:]
                tokens = _tokens(clean)
                others = [w for w in tokens if w not in forms]
                usual.update(tokens)
                by_book[book].update(others)
                rare = sorted({w.lower() for w in set(others) if len(w) > 2 and not (len(w) > 3 and w.isupper()) and not w.isdigit()} - common)
                rows.append((0, table, key, book, header, number, ["\t".join(x[2:]) for x in breaks], rare, None, None, None))
            # One row of words and counts a book, and one for the common words of all.
            general, shown = Counter(), Counter()
            for form in forms:
                if n := usual.get(form, 0):
                    general[form.lower()] += n
                    shown[form.lower()] += n if form[0].isupper() else 0
            for book, counts in by_book.items():
                own: dict[str, list[int]] = {}
                for form, n in counts.items():
                    word = form.lower()
                    capital = n if form[0].isupper() else 0
                    if word in common:
                        general[word] += n
                        shown[word] += capital
                    elif not word.isdigit():
                        have = own.setdefault(word, [0, 0])
                        have[0] += n
                        have[1] += capital
                if own:
                    rows.append((1, None, 0, book, False, False, None, None, list(own), [n for n, _ in own.values()], [c for _, c in own.values()]))
            if general:
                rows.append((1, None, 0, None, False, False, None, None, list(general), list(general.values()), [shown[w] for w in general]))
            out = pd.DataFrame(rows, columns=["kind", "table_name", "key", "book", "header", "page_number", "breaks", "rare", "words", "n", "capitals"])
            out["book"] = out["book"].astype("Int64")
            yield out

    return run


_PASS = "kind int, table_name string, key long, book long, header boolean, page_number boolean, breaks array<string>, rare array<string>, words array<string>, n array<long>, capitals array<long>"


def _grams(word: Column) -> Column:
    """Distinct two-letter grams of a word with its ends marked."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def confusion_cost(read: str, printed: str) -> tuple[float, int, int]:
    """Least cost of turning a printed word into what was read: (cost, confusions, other edits).

    A known confusion costs 0.3, any other edit 1.
    """
    start, end = 0, 0
    while start < min(len(read), len(printed)) and read[start] == printed[start]:
        start += 1
    while end < min(len(read), len(printed)) - start and read[-1 - end] == printed[-1 - end]:
        end += 1
    # A confusion of two letters may reach one letter into what is equal.
    start, end = max(0, start - 1), max(0, end - 1)
    a, b = read[start : len(read) - end], printed[start : len(printed) - end]
    best: dict[tuple[int, int], tuple[float, int, int]] = {(0, 0): (0.0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            now = best.get((i, j))
            if now is None:
                continue
            c, k, o = now
            steps = []
            if i < len(a) and j < len(b):
                steps.append((i + 1, j + 1, (c, k, o) if a[i] == b[j] else (c + 1, k, o + 1)))
            if i < len(a):
                steps.append((i + 1, j, (c + 1, k, o + 1)))
            if j < len(b):
                steps.append((i, j + 1, (c + 1, k, o + 1)))
            for x, y in _BY_FIRST.get(a[i] if i < len(a) else "", ()):
                if a.startswith(x, i) and b.startswith(y, j):
                    steps.append((i + len(x), j + len(y), (c + 0.3, k + 1, o)))
            for p, q, value in steps:
                if (p, q) not in best or value < best[(p, q)]:
                    best[(p, q)] = value
    return best[(len(a), len(b))]


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _x, _y in CONFUSIONS:
    _BY_FIRST.setdefault(_x[0], []).append((_x, _y))


def _features(wrong: str, right: str, n_wrong: float, n_right: float, in_book: bool) -> list[float]:
    cost, known, other = confusion_cost(wrong, right)
    return [
        cost,
        known,
        other,
        cost / max(1, len(right)),
        len(right),
        np.log1p(n_right),
        np.log1p(n_wrong),
        np.log((n_right + 1) / (n_wrong + 1)),
        float(any(c.isdigit() or c in "!|" for c in wrong)),
        float(wrong[0] == right[0]),
        float(wrong[-1:] == right[-1:]),
        float(abs(len(wrong) - len(right))),
        float(in_book),
    ]


def fit_ranker(words: list[tuple[str, int]], seed: int = 7) -> Boosted:
    """Boosted trees that tell misreadings from other rare words.

    Fitted on at most ``SAMPLE_PAIRS`` pairs made from counted words: words with
    one or two confusions put in are misreadings; words with other edits, words
    cut or lengthened, and pairs of different words are not.
    """
    rng = np.random.default_rng(seed)
    usable = [(w, n) for w, n in words if len(w) >= 3 and w.isalpha()]
    x, y = [], []
    if not usable:
        return Boosted()
    for _ in range(SAMPLE_PAIRS // 3):
        word, n = usable[rng.integers(len(usable))]
        few = max(1, int(n * rng.uniform(0, 1.2 / RATIO)))
        at = rng.integers(len(word))
        fits = [(a, b) for a, b in CONFUSIONS if b in word]
        if fits:
            a, b = fits[rng.integers(len(fits))]
            wrong = word.replace(b, a, 1)
            if rng.random() < 0.25 and (more := [(p, q) for p, q in CONFUSIONS if q in wrong and q != a]):
                a, b = more[rng.integers(len(more))]
                wrong = wrong.replace(b, a, 1)
            x.append(_features(wrong, word, few, n, bool(rng.random() < 0.5)))
            y.append(1)
        letter = "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)]
        edited = (word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word + "s")[rng.integers(4)]
        if edited != word and edited and confusion_cost(edited, word)[2]:
            x.append(_features(edited, word, few, n, bool(rng.random() < 0.5)))
            y.append(0)
        other = usable[rng.integers(len(usable))][0]
        if other != word and abs(len(other) - len(word)) <= 2 and confusion_cost(other, word)[2]:
            x.append(_features(other, word, few, n, bool(rng.random() < 0.5)))
            y.append(0)
    return Boosted().fit(np.array(x), np.array(y))


def _ranked(ranker: Boosted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([_features(w, r, a, b, k >= 0) for w, r, a, b, k in batch[["wrong", "right", "n_wrong", "n_right", "book"]].itertuples(index=False, name=None)])
            # An edit that no scanner makes rules a pair out; so do more confusions than one in four letters.
            fits = (x[:, 2] == 0) & (x[:, 1] <= 1 + x[:, 4] // 4)
            yield batch.assign(score=np.where(fits, ranker.score(x), 0.0), cost=x[:, 0])

    return run


def correction_candidates(suspects: DataFrame, words: DataFrame, within: bool) -> DataFrame:
    """Pairs of a suspect word and a common one that may be its right form.

    ``suspects`` and ``words`` have ``book``, ``word`` and ``n``.  The inverted
    list holds every gram of the common words; a suspect looks up its rarest
    grams only, one more than the edits looked for can destroy, so no pair within
    three edits of long words and two of short ones is missed (words of up to
    five letters look up all).
    """
    on = ["book", "gram"] if within else ["gram"]
    listed = words.select(*(["book"] if within else []), F.col("word").alias("right"), F.col("n").alias("n_right"), F.explode(_grams(F.col("word"))).alias("gram"))
    sizes = listed.groupBy(*on).agg(F.count(F.lit(1)).alias("size"))
    asked = suspects.select("book", F.col("word").alias("wrong"), F.col("n").alias("n_wrong"), F.explode(_grams(F.col("word"))).alias("gram"))
    asked = asked.join(broadcast_if_small(sizes) if not within else sizes, on, "left")
    rank = F.row_number().over(Window.partitionBy("book", "wrong").orderBy(F.coalesce("size", F.lit(0)), "gram"))
    few = F.when(F.length("wrong") <= 5, F.lit(99)).otherwise(F.lit(7))
    asked = asked.withColumn("rank", rank).filter((F.col("rank") <= few) & F.col("size").isNotNull()).drop("size", "rank")
    ratio = F.lit(BOOK_RATIO if within else RATIO)
    fits = (F.col("wrong") != F.col("right")) & (F.col("n_right") >= ratio * F.col("n_wrong"))
    if within:
        pairs = asked.join(listed, on).filter(fits & (F.abs(F.length("wrong") - F.length("right")) <= 2))
    else:
        # The length is part of the key, so a frequent gram meets only words of a fitting length.
        asked = asked.withColumn("size", F.explode(F.transform(F.array(*map(F.lit, range(-2, 3))), lambda d: F.length("wrong") + d)))
        pairs = asked.join(broadcast_if_small(listed.withColumn("size", F.length("right"))), [*on, "size"]).filter(fits)
    edits = F.when(F.length("right") >= 6, F.lit(3)).otherwise(F.lit(2))
    near = pairs.filter(F.levenshtein("wrong", "right", 3).between(0, edits))
    return near.select("book", "wrong", "right", "n_wrong", "n_right").distinct()


def _sample(df: DataFrame, rows: int, *keys: str) -> pd.DataFrame:
    """About ``rows`` rows of a small table, by hash and so the same each time; what the driver gets doesn't grow with it."""
    return _part(df, rows, df.count(), *keys).limit(2 * rows).toPandas()


def _part(df: DataFrame, rows: int, of: int, *keys: str) -> DataFrame:
    """About ``rows`` of ``of`` rows, by hash."""
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(max(1, of // rows))) == 0)


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word counts, features of lines and names of a batch."""
    for batch in batches:
        counts, capitals, rows, names = Counter(), Counter(), [], set()
        for text, book_name, author in batch[["text", "book_name", "author"]].itertuples(index=False, name=None):
            for form in _tokens(text):
                counts[form.lower()] += 1
                capitals[form.lower()] += form[0].isupper()
            rows += [(1, None, 0, 0, x) for _, x in _Lines(text, [book_name, author]).found]
            names |= {n for n in (book_name, author) if n}
        rows += [(0, w, n, capitals[w], None) for w, n in counts.items()] + [(2, n, 0, 0, None) for n in names]
        yield pd.DataFrame(rows, columns=["kind", "word", "n", "capitals", "x"])


class ScanFaults:
    """What the first pass and the counts tell of the texts."""

    def __init__(self, rows: DataFrame, fixes: DataFrame, joins: DataFrame, models: dict[str, Boosted]) -> None:
        self.rows, self.fixes, self.joins, self.models = rows, fixes, joins, models


def find_faults(texts: DataFrame) -> ScanFaults:
    """Faults of texts (``table_name``, ``key``, ``book``, ``text``, ``book_name``, ``author``).

    ``rows`` has one row per text with ``header`` and ``page_number``; ``fixes``
    has (``table_name``, ``key``, ``wrong``, ``right``) for each misread word of
    a text; ``joins`` has (``table_name``, ``key``, ``left``, ``right``) for each
    word broken at a line end.  Null and empty texts have no row.
    """
    spark = texts.sparkSession
    texts = texts.filter(F.length("text") > 0).select("table_name", "key", "book", "text", "book_name", "author")
    total = texts.count()
    least = max(8, total / COMMON_TEXTS)
    sample = cut_lineage(_part(texts, SAMPLE_ROWS, total, "table_name", "key").mapInPandas(_sampled, "kind int, word string, n long, capitals long, x array<double>"))
    texts_seen = sample.filter("kind = 0").groupBy("word").agg(F.sum("n").alias("n"), F.sum("capitals").alias("capitals"))
    # Words clearly more frequent in the sample than a common one must be: their number is bounded by the words of a text.
    near = texts_seen.filter(
        (F.col("n") >= COMMON_MARGIN * max(8, min(total, SAMPLE_ROWS) / COMMON_TEXTS)) & (F.col("n") - F.col("capitals") >= COMMON_MARGIN * COMMON_SMALL * F.col("n")) & F.col("word").rlike(r"^\p{L}{2,}$")
    )  # single letters also come from headers set with blanks between the letters
    skip = {r["word"] for r in near.select("word").collect()}
    labelled = sample.filter("kind = 1").withColumn("h", F.xxhash64("x", "word")).orderBy("h").limit(SAMPLE_PAIRS).select("x").toPandas()["x"]
    titles = sorted(r["word"] for r in sample.filter("kind = 2").select("word").distinct().orderBy(F.xxhash64("word")).limit(SAMPLE_ROWS).collect())
    models = fit_furniture([list(map(float, x)) for x in labelled], titles)
    while True:
        first = cut_lineage(texts.mapInPandas(_first_pass(skip, models), _PASS))
        counted = first.filter("kind = 1").select("book", F.explode(F.arrays_zip("words", "n", "capitals")).alias("c")).select("book", F.col("c.words").alias("word"), "c.n", "c.capitals")
        by_book = counted.groupBy("book", "word").agg(F.sum("n").alias("n"), F.sum("capitals").alias("capitals"))
        by_book = cut_lineage(by_book)
        totals = by_book.groupBy("word").agg(F.sum("n").alias("n"), F.sum("capitals").alias("capitals"), F.count(F.lit(1)).alias("books"))
        # What is common is told by the counts of all texts; the sample only spared counting some words by book.
        exact = (F.col("n") >= least) & (F.col("n") - F.col("capitals") >= COMMON_SMALL * F.col("n")) & F.col("word").rlike(r"^\p{L}+$")
        totals = totals.withColumn("common", exact)
        wrong = {r["word"] for r in by_book.filter("book is null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("capitals").alias("capitals")).filter(~exact).select("word").collect()} & skip
        if not wrong:
            break
        skip -= wrong
    rows = first.filter("kind = 0")
    plain = F.col("word").rlike(r"^\p{L}+(-\p{L}+)*$")
    general = totals.filter(plain & (F.length("word") >= 3) & (F.col("common") | ((F.col("n") >= RATIO) & (F.col("books") >= 4)))).select(F.lit(-1).cast("long").alias("book"), "word", "n")
    usual = broadcast_if_small(totals.filter("common").select("word"))
    own_words = by_book.filter(F.col("book").isNotNull() & (F.length("word") >= 3)).join(usual, "word", "left_anti")
    names = own_words.filter(plain & (F.col("n") >= BOOK_RATIO))
    odd_word = F.length("word") >= 3
    words = _sample(general, SAMPLE_PAIRS // 3, "word").sort_values("word")
    ranker = _ranked(fit_ranker(list(zip(words["word"], words["n"].astype(int)))))
    pair = "book long, wrong string, right string, n_wrong long, n_right long, score double, cost double"
    odd = F.col("wrong").rlike(r"[0-9!|]")
    # Short words are too alike for anything but a foreign character, or the book's own names, to tell.
    sure = (F.col("score") >= 0.5) & (odd | (F.length("right") >= 4) | (F.col("n_right") >= 200 * F.col("n_wrong")))
    in_book = cut_lineage(correction_candidates(own_words, names, True).mapInPandas(ranker, pair).filter(sure))
    # A word that a book writes with a capital, again and again, is a name of its own, unless it holds a
    # foreign character or the same book has its right form far more often.
    is_name = F.col("book").isNotNull() & (F.col("capitals") >= 0.8 * F.col("n")) & (F.col("n") >= NAME_TIMES) & ~F.col("word").rlike(r"[0-9!|]")
    misread = in_book.select("book", F.col("wrong").alias("word")).distinct()
    own = own_words.filter(is_name).join(misread, ["book", "word"], "left_anti")
    named = own.groupBy("word").agg(F.sum("n").alias("named"))
    unnamed = F.col("n") - F.coalesce("named", F.lit(0))
    suspects = totals.filter(~F.col("common") & odd_word).join(named, "word", "left").filter(unnamed > 0).select(F.lit(-1).cast("long").alias("book"), "word", unnamed.alias("n"))
    scored = correction_candidates(suspects, general, False).mapInPandas(ranker, pair).filter(sure).unionByName(in_book)
    best = Window.partitionBy("book", "wrong").orderBy(F.desc("score"), "cost", F.desc("n_right"), "right")
    fixes = scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select(F.col("book").alias("fix_book"), "wrong", "right", "cost")
    fixes = broadcast_if_small(fixes)
    tokens = rows.select("table_name", "key", "book", F.explode("rare").alias("wrong"))  # common words have no fixes
    own = own.select("book", F.col("word").alias("wrong")).join(fixes.select("wrong"), "wrong", "left_semi")
    found = (
        tokens.join(fixes, "wrong")
        .filter((F.col("fix_book") == -1) | (F.col("fix_book") == F.col("book")))
        .join(own, ["book", "wrong"], "left_anti")
        .groupBy("table_name", "key", "wrong")
        .agg(F.min_by("right", F.struct("cost", -F.col("fix_book"))).alias("right"))
    )
    return ScanFaults(rows.select("table_name", "key", "book", "header", "page_number"), found, _broken_words(rows, totals), models)


def _broken_words(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Hyphens at line ends that break a word, by a classifier over the two line ends.

    A break whose whole word is known and was never seen with the hyphen is a
    sure case, one that is known with the hyphen only is the opposite; the trees
    are fitted on a bounded sample of these and decide the rest.
    """
    pieces = rows.select("table_name", "key", F.explode("breaks").alias("pair")).groupBy("table_name", "key", "pair").agg(F.count(F.lit(1)).alias("times"))
    pieces = pieces.withColumn("left", F.substring_index("pair", "\t", 1)).withColumn("right", F.substring_index("pair", "\t", -1)).drop("pair")
    counted = totals.select("word", "n")
    kinds = pieces.select("left", "right").distinct()
    for name, word in (("whole", F.concat("left", "right")), ("hyphened", F.concat_ws("-", "left", "right")), ("first", F.col("left")), ("second", F.col("right"))):
        kinds = kinds.withColumn("word", word).join(counted.withColumnRenamed("n", name), "word", "left").drop("word")
    kinds = cut_lineage(kinds.fillna(0, ["whole", "hyphened", "first", "second"]))
    known = _sample(kinds.filter("(whole >= 20 and hyphened = 0) or (hyphened >= 5 and whole <= 2)"), SAMPLE_PAIRS, "left", "right")
    model = Boosted(trees=30, depth=2).fit(_break_features(known), (known["whole"] >= 20).to_numpy(float)) if len(known) else Boosted()

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                score = model.score(_break_features(batch)) if model.model else np.ones(len(batch))
                yield batch.assign(broken=np.where(batch["hyphened"] == 0, score > 0.2, score >= 0.5))[["left", "right", "broken"]]

    decided = kinds.mapInPandas(decide, "left string, right string, broken boolean").filter("broken")
    return pieces.join(broadcast_if_small(decided), ["left", "right"]).select("table_name", "key", "left", "right", "times")


def _break_features(pairs: pd.DataFrame) -> np.ndarray:
    """Of two line ends: how often the whole, the hyphened form and the parts occur, and their lengths."""
    return np.column_stack(
        [
            np.log1p(pairs["whole"]) - np.log1p(pairs["hyphened"]),
            np.log1p(pairs["hyphened"]),
            np.minimum(np.log1p(pairs["first"]), np.log1p(pairs["second"])),
            pairs["left"].str.len(),
            pairs["right"].str.len(),
        ]
    ).astype(float)


def fault_kinds(texts: DataFrame) -> DataFrame:
    """(``table_name``, ``row_key``, ``kind``) for each kind of fault in each text."""
    faults = find_faults(texts)
    key = [F.col("table_name"), F.col("key").alias("row_key")]
    out = faults.rows.filter("header").select(*key, F.lit("header").alias("kind"))
    out = out.unionByName(faults.rows.filter("page_number").select(*key, F.lit("page_number").alias("kind")))
    out = out.unionByName(faults.fixes.select(*key).distinct().withColumn("kind", F.lit("misread")))
    return out.unionByName(faults.joins.select(*key).distinct().withColumn("kind", F.lit("hyphen")))


def _rewrite(models: dict[str, Boosted]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = _furniture_of([(t, [b, a]) for t, b, a in zip(batch["text"], batch["book_name"], batch["author"])], models)
            out = []
            for (_, _, clean), fixes, joins in zip(plain, batch["fixes"], batch["joins"]):
                out.append(repaired(clean, dict(fixes or {}), {tuple(j.split("\t")) for j in (joins if joins is not None else ())}))
            yield batch[["table_name", "key"]].assign(repaired=out)

    return run


def repaired(clean: str, fixes: dict[str, str], joins: set[tuple[str, str]]) -> str:
    """A text, its furniture gone, with broken words joined, misread words replaced and wrapped lines run on."""
    for start, end, left, after in reversed(_breaks(clean)):
        clean = clean[:start] + ("" if (left, after) in joins else "-") + clean[end:]

    def right(found: re.Match) -> str:
        word = fixes.get(found[0].lower())
        if word is None:
            return found[0]
        return word.upper() if found[0].isupper() and len(word) > 1 else word.capitalize() if found[0][0].isupper() else word

    clean = _TOKEN.sub(right, clean)
    blocks = [re.sub(r"\s+", " ", b).strip() for b in re.split(r"\n\s*\n", clean)]
    return "\n\n".join(b for b in blocks if b)


def repair_scans(texts: DataFrame) -> DataFrame:
    """(``table_name``, ``key``, ``repaired``): every text as continuous paragraphs.

    Null and empty texts come out as they are.
    """
    faults = find_faults(texts)
    fixes = faults.fixes.groupBy("table_name", "key").agg(F.map_from_entries(F.collect_list(F.struct("wrong", "right"))).alias("fixes"))
    joins = faults.joins.groupBy("table_name", "key").agg(F.collect_set(F.concat_ws("\t", "left", "right")).alias("joins"))
    full = texts.filter(F.length("text") > 0).join(fixes, ["table_name", "key"], "left").join(joins, ["table_name", "key"], "left")
    done = full.select("table_name", "key", "text", "book_name", "author", "fixes", "joins").mapInPandas(_rewrite(faults.models), "table_name string, key long, repaired string")
    return done.unionByName(texts.filter(F.coalesce(F.length("text"), F.lit(0)) == 0).select("table_name", "key", F.col("text").alias("repaired")))
