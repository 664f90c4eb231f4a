"""Variant spellings of names typed by people.

Rows are blocked by phonetic codes of their sorted name tokens, compared with
Jaro-Winkler and a table of nicknames, to which nicknames given by the book and
pet forms of a name are added, and accepted pairs are clustered by connected
components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.lookalikes import skeleton
from inkloom.operators.packed import split_packed
from inkloom.session import cut_lineage

# Titles before a name, kinds of organisations, endings of pet names, and who is meant by an epithet.
TITLES = set(
    "mr mrs ms miss sir dame lord lady king queen prince princess master mstr mistress doctor dr professor prof captain capt cpt "
    "general gen colonel col major maj lieutenant lt sergeant sgt brother br bro sister sr mother father fr saint st mere père pere".split()
)
KINDS = "company brotherhood society association guild order house council league union fellowship institute corporation".split()
KIND_SHORT = {"co": "company", "cpy": "company", "soc": "society", "assn": "association", "assoc": "association", "bhd": "brotherhood", "bros": "brotherhood", "gld": "guild", "ord": "order", "corp": "corporation", "inst": "institute"}
PET_ENDINGS = ("ix", "ie", "y", "o", "i", "us")
ELDER = {"elder": "elder", "senior": "elder", "sr": "elder", "younger": "younger", "junior": "younger", "jr": "younger"}
# Common nicknames, as "name: nicknames".
NICKNAMES = """
Albert: Al Bert   Alexander: Alec Sandy Sasha   Andrew: Andy Drew   Ann: Nan Nancy Annie   Anthony: Tony   Catherine: Cathy Kate Kitty
Charles: Charlie Chuck   Christopher: Chris Kit   Daniel: Dan Danny   Dorothy: Dolly Dot   Edward: Eddie Ned Ted   Eleanor: Ellie Nell Nora
Elizabeth: Bess Beth Betty Eliza Liz Lizzie   Francis: Frank   Gilbert: Bert Gil   Helen: Nell Nellie   Henry: Hal Hank Harry   Isabella: Bella Izzy
James: Jem Jim Jimmy   John: Jack Johnny   Joseph: Joe   Katherine: Kate Kathy Kitty   Lawrence: Larry   Margaret: Greta Maggie Meg Peggy
Martha: Patty   Mary: Molly Polly   Matilda: Tilly   Michael: Mick Mike   Nicholas: Nick   Patrick: Paddy Pat   Philip: Pip
Rebecca: Becky   Richard: Dick Rich Rick   Robert: Bob Bobby Rob Robin   Samuel: Sam   Sarah: Sally   Stephen: Steve   Susan: Sue
Theodore: Ted Theo   Thomas: Tom Tommy   Walter: Walt Wat   William: Bill Billy Will Willie
"""
_FILL = {"the", "of", "and", "&"}
#: Letters of a phonetic code, as codes have a length; names that are alike so far share a block whatever follows.
CODE_LENGTH = 6
#: Jaro-Winkler similarity from which two words are looked at, and from which two edits may part them.  The first is
#: below what one edit leaves of words of three letters or more, even where it makes letters match others than their own.
SIMILAR, VERY_SIMILAR = 0.7, 0.88
#: Edges of a book up to which one task finds its components; those of larger books are found by rounds over all tasks.
BOOK_EDGES = 2_000_000


def _nicknames() -> set[tuple[str, str]]:
    """(name, nickname) pairs of the table, in lower case."""
    out, name = set(), ""
    for word in NICKNAMES.casefold().split():
        if word.endswith(":"):
            name = word[:-1]
        else:
            out.add((name, word))
    return out


KNOWN = _nicknames()
_NAMES_OF: dict[str, list[str]] = {}
for _name, _nick in sorted(KNOWN):
    _NAMES_OF.setdefault(_nick, []).append(_name)
    _NAMES_OF.setdefault(_name, [_name])
_NODE = "book long, node long, mark string, name string, kind string, first string, last string, nick string, epithet string, rest string, short boolean, role string, noun string, pronoun string, target string, codes array<string>"


def plain(text: str) -> str:
    """Lower case without accents; apostrophes and hyphens within words dropped."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _INNER.sub("", text).casefold()


_INNER = re.compile(r"(?<=\w)['’‘`‐‑-](?=\w)")


def phonetic(token: str) -> str:
    """First letter class and consonant classes of a token, doubles and vowels left out, to the length of a code."""
    out, last = [], ""
    for c in token:
        code = _CLASS.get(c, "")
        if code and code != last:
            out.append(code)
        last = code if code else ("" if c in "aeiouy" else last)
    return (_FIRST.get(token[0], token[0]) if token else "") + "".join(out[1:] if out and _CLASS.get(token[0]) else out)[:CODE_LENGTH]


_CLASS = {c: k for k, cs in {"1": "bpfv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}
_FIRST = {"c": "k", "q": "k", "z": "s", "x": "s", "g": "j", "f": "v", "p": "b", "t": "d"} | dict.fromkeys("aeiouy", "a")


def codes(tokens: list[str]) -> list[str]:
    """Block keys of a name: of each sorted token its phonetic code, its sorted consonant classes, its beginning, and the names of which it is a nickname."""
    return sorted(set().union(*(_codes_of(t) for t in tokens if len(t) >= 2)))


@lru_cache(maxsize=100_000)
def _codes_of(token: str) -> frozenset[str]:
    classes = "".join(sorted({_CLASS.get(c, "") for c in token}))
    return frozenset({"p" + phonetic(token), f"s{classes}{len(token) // 4}", "b" + token[:3], *("n" + name for name in _NAMES_OF.get(token, ()))})


@lru_cache(maxsize=200_000)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity; letters may lie one place apart even in the shortest words, as swapped ones do."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(1, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(hits, other)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours counting once."""
    before, now = [], list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        older, before, now = before, now, [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            now[j] = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                now[j] = min(now[j], older[j - 2] + 1)
    return now[-1]


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> bool:
    """One word up to a typo: similar by Jaro-Winkler, and then, exactly, at most one edit apart, or two in long words that are very similar."""
    if a == b:
        return True
    short = min(len(a), len(b))
    if short < 3 or abs(len(a) - len(b)) > 2:
        return False
    similar = jaro_winkler(a, b)
    if similar < SIMILAR:
        return False
    return edits(a, b) <= (2 if short >= 6 and similar >= VERY_SIMILAR else 1)


def parse(name: str) -> dict:
    """Parts of a name as typed.

    ``kind`` is person, group (an organisation) or letters (its initials);
    ``short`` tells that the family name is an abbreviation.
    """
    nick = ""
    quoted = re.search(r"[“\"「]([^”\"」]+)[”\"」]", name)
    if quoted:
        nick = plain(quoted[1]).strip()
        name = name[: quoted.start()] + " " + name[quoted.end() :]
    letters = re.sub(r"[\s.]", "", name)
    text = plain(name)
    tokens = re.findall(r"[\w]+\.?|&|,", text)
    bare = [t.rstrip(".") for t in tokens if t != ","]
    several = "&" in tokens or "and" in bare
    initials = re.match(r"\s*((?:[^\W\d_]\.){2,4})\s+(\S+)\s*$", name)
    if initials:
        core = plain(initials[2])
        return {"kind": "group", "first": core, "last": "", "nick": plain(initials[1]).replace(".", ""), "epithet": "", "rest": core, "short": False, "tokens": [core]}
    kinds = [KIND_SHORT[t] for t in bare[-1:] if t in KIND_SHORT and t + "." in tokens] + [k for k in KINDS for t in (bare[:1] + bare[-1:]) if t == k or (several and len(t) >= 2 and k.startswith(t) and (t + "." in tokens))]
    if "&" in tokens or (kinds and len(bare) > 1):
        kind = kinds[0] if kinds else ""
        core = [t for t in bare if t not in _FILL and t != kind and KIND_SHORT.get(t) != kind and not (kind and kind.startswith(t) and t + "." in tokens)]
        return {"kind": "group", "first": core[0] if core else "", "last": core[1] if len(core) > 1 else "", "nick": "", "epithet": kind, "rest": " ".join(core), "short": False, "tokens": core}
    if letters.isupper() and 2 <= len(letters) <= 4 and letters.isalpha() and not re.search(r"[aeiouyAEIOUY]", letters[1:]):
        return {"kind": "letters", "first": "", "last": letters.lower(), "nick": "", "epithet": "", "rest": letters.lower(), "short": False, "tokens": [letters.lower()]}
    epithet = ""
    named = re.search(r"\s(?:the\s+)?(\w+)\.?\s*$", text)
    if named and (named[1] in ELDER or re.search(r"\sthe\s+\w+\s*$", text)):
        epithet = ELDER.get(named[1], named[1])
        text = text[: named.start()]
    opening = re.match(r"\s*(\w+)\.?\s+(?=\w+\s*,)", text)
    if opening and opening[1] in TITLES:
        text = text[opening.end() :]
    if "," in text:
        after, _, before = text.partition(",")
        text = f"{before} {after}"
    tokens = re.findall(r"\w+\.?", text)
    while len(tokens) > 1 and tokens[0].rstrip(".") in TITLES:
        tokens = tokens[1:]
    bare = [t.rstrip(".") for t in tokens]
    short = bool(tokens) and tokens[-1].endswith(".") and len(bare[-1]) >= 2
    if len(bare) <= 1:
        first, last = "", bare[0] if bare else ""
    else:
        inner = [t for t in bare[1:-1] if len(t) > 1]
        first, last = bare[0], "".join(inner) + bare[-1]
    return {"kind": "person", "first": first, "last": last, "nick": nick, "epithet": epithet, "rest": " ".join(bare), "short": short, "tokens": [t for t in dict.fromkeys([first, last, *bare[1:], nick]) if t]}


def is_pet_name(nick: str, first: str) -> bool:
    """Whether a nickname is the beginning of a first name with a common ending."""
    for ending in PET_ENDINGS:
        if nick.endswith(ending) and len(nick) > len(ending):
            stem = nick[: -len(ending)]
            if first.startswith(stem):
                return True
    return len(nick) >= 2 and first.startswith(nick)


def _noun(role: str) -> str:
    return role.split()[-1] if role else ""


def same_role(a: dict, b: dict) -> bool | None:
    """True for the same role, one of them perhaps without its adjective; False for two roles; None where one is missing."""
    x, y = a["role"], b["role"]
    if not x or not y:
        return None
    if x == y:
        return True
    short, long = sorted((x, y), key=len)
    return len(short.split()) == 1 and long.split()[-1] == short and " of " not in long


def compare(a: dict, b: dict, pets: set[tuple[str, str]]) -> int:
    """2 if two rows of a book mean the same, 1 if they may if nobody else fits, 0 if not."""
    role = same_role(a, b)
    if role is False or (a["pronoun"] and b["pronoun"] and a["pronoun"] != b["pronoun"]):
        return 0
    if a["epithet"] != b["epithet"] and a["kind"] == b["kind"] == "person" and a["epithet"] and b["epithet"]:
        return 0
    target = bool(a["target"]) and a["target"] == b["target"]
    if "group" in (a["kind"], b["kind"]) or "letters" in (a["kind"], b["kind"]):
        return _compare_groups(a, b, role, target)
    sure = role is True or target
    last = _last_fits(a, b)
    first = _first_fits(a, b, pets)
    loose = a["epithet"] != b["epithet"] and not sure
    if a["first"] and b["first"]:
        swapped = alike(a["first"], b["last"]) and alike(a["last"], b["first"])
        if swapped or (last and first == "full"):
            return 1 if loose else 2
        if last and first == "nick":
            return 1 if loose else 2
        if last and first == "initial":
            return 2 if sure else 1
        if sure and (last or first == "full") and (jaro_winkler(a["last"], b["last"]) >= 0.75 or jaro_winkler(a["first"], b["first"]) >= 0.8) and last:
            return 2 if jaro_winkler(a["first"], b["first"]) >= 0.8 else 0
        if sure and a["last"] == b["last"] and min(len(a["first"]), len(b["first"])) > 1 and edits(a["first"], b["first"]) <= 1:
            return 2
        if sure and first == "full" and jaro_winkler(a["last"], b["last"]) >= 0.8:
            return 2
        return 0
    # One of them is a single word: a family name, a first name or a nickname.
    one, other = (a, b) if not a["first"] else (b, a)
    word = one["last"]
    if not other["first"]:
        fits = alike(word, other["last"]) or (one["nick"] and one["nick"] == other["nick"])
        return (2 if role is not None or target or word == other["last"] else 1) if fits else 0
    if alike(word, other["last"]) or (other["short"] and word.startswith(other["last"])):
        return 2 if sure else 1
    if alike(word, other["first"]) or word == other["nick"] or (other["first"], word) in pets or (other["first"], word) in KNOWN:
        return 2 if sure else 1
    return 0


def _last_fits(a: dict, b: dict) -> bool:
    x, y = a["last"], b["last"]
    if a["short"] or b["short"]:
        short, long = (x, y) if a["short"] else (y, x)
        return long.startswith(short) or short.startswith(long[: len(short)]) or (len(short) >= 3 and edits(short, long[: len(short)]) <= 1)
    return alike(x, y)


def _first_fits(a: dict, b: dict, pets: set[tuple[str, str]]) -> str:
    x, y = a["first"], b["first"]
    if not x or not y:
        return ""
    if len(x) == 1 or len(y) == 1:
        return "initial" if x[0] == y[0] else ""
    if alike(x, y):
        return "full"
    for one, other in ((a, b), (b, a)):
        nick, name = one["first"], other["first"]
        if other["nick"] == nick or (name, nick) in pets or (name, nick) in KNOWN or is_pet_name(nick, name):
            return "nick"
        if one["nick"] and one["nick"] == other["nick"]:
            return "nick"
    return ""


def _compare_groups(a: dict, b: dict, role: bool | None, target: bool) -> int:
    if a["kind"] == b["kind"] == "group" and (a["nick"] or b["nick"]):
        # One is given by its initials and first word.
        short = {x["nick"] or x["first"][:1] + x["last"][:1] + x["epithet"][:1] for x in (a, b)}
        return 2 if len(short) == 1 and alike(a["first"], b["first"]) else 0
    if a["kind"] == b["kind"] == "group":
        if a["epithet"] and b["epithet"] and a["epithet"] != b["epithet"]:
            return 0
        both = a["last"] and b["last"]
        if both and alike(a["first"], b["first"]) and alike(a["last"], b["last"]):
            return 2
        if both and alike(a["first"], b["last"]) and alike(a["last"], b["first"]):
            return 2
        if both and (role or target) and jaro_winkler(a["first"], b["first"]) >= 0.75 and jaro_winkler(a["last"], b["last"]) >= 0.75:
            return 2
        if not both and alike(a["first"], b["first"]):
            return 2 if role or target else 1
        return 0
    if {a["kind"], b["kind"]} == {"group", "letters"}:
        group, letters = (a, b) if a["kind"] == "group" else (b, a)
        initials = group["first"][:1] + group["last"][:1] + group["epithet"][:1]
        return (2 if role or target else 1) if letters["last"] == initials else 0
    return 2 if a["kind"] == b["kind"] == "letters" and a["last"] == b["last"] else 0


def _parse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for book, node, mark, name, role, pronoun, target in batch[["book", "node", "mark", "name", "role", "pronoun", "target"]].itertuples(index=False, name=None):
            p = parse(name)
            role = " ".join((role or "").split()).casefold()
            keys = codes(p["tokens"])
            if p["kind"] == "group":
                keys.append("l" + p["first"][:1] + p["last"][:1] + p["epithet"][:1])
            elif p["kind"] == "letters":
                keys.append("l" + p["last"])
            rows.append((book, node, mark, name, p["kind"], p["first"], p["last"], p["nick"], p["epithet"], p["rest"], p["short"], role, _noun(role), (pronoun or "").strip().casefold(), skeleton(target) or "", keys))
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _NODE.split(", ")])


def _pets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for book, text in batch[["book", "text"]].itertuples(index=False, name=None):
            p = parse(text)
            if p["nick"] and p["first"]:
                rows.append((book, p["first"], p["nick"]))
        yield pd.DataFrame(rows, columns=["book", "first", "nick"])


def _compare_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("kind", "first", "last", "nick", "epithet", "rest", "short", "role", "noun", "pronoun", "target")
    for batch in batches:
        rows = []
        columns = {side: [batch[f"{n}_{side}"].tolist() for n in names] for side in "ab"}
        known = batch["pets"].tolist() if "pets" in batch else [None] * len(batch)
        for i, (x, y, book) in enumerate(zip(batch["node_a"], batch["node_b"], batch["book"])):
            a, b = (dict(zip(names, (c[i] for c in columns[side]))) for side in "ab")
            pets = {tuple(p.split("\t")) for p in known[i]} if known[i] is not None else set()
            grade = compare(a, b, pets)
            if grade:
                weak = 0 if grade == 2 else (2 if not a["first"] or len(a["first"]) == 1 else 1 if not b["first"] or len(b["first"]) == 1 else 1 if a["epithet"] else 2)
                rows.append((book, x, y, grade, weak))
        yield pd.DataFrame(rows, columns=["book", "a", "b", "grade", "weak"])


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of the edges of one book after the other; a book's edges come together, perhaps over several batches."""
    book, parent = None, {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def closed() -> pd.DataFrame:
        return pd.DataFrame([(x, top(x)) for x in list(parent)], columns=["node", "root"])

    for batch in batches:
        for own, a, b in batch[["book", "a", "b"]].itertuples(index=False, name=None):
            if own != book:
                if parent:
                    yield closed()
                book, parent = own, {}
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    if parent:
        yield closed()


def components(edges: DataFrame, book_edges: int = BOOK_EDGES) -> DataFrame:
    """(``node``, ``root``) for every node of an edge list (``book``, ``a``, ``b``): the smallest node that is connected with it.

    No edge leaves its book.  A book of at most ``book_edges`` edges is one task's
    work.  In larger ones every node takes the least label around it and then that
    node's own label, round by round until nothing changes, so rounds grow with the
    logarithm of the longest chain; each round is written to the shared folder.
    Both ways give the same; nothing is collected.
    """
    edges = cut_lineage(edges.select("book", "a", "b"))
    large = cut_lineage(edges.groupBy("book").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > book_edges).select("book"))
    if large.isEmpty():
        return edges.repartition("book").sortWithinPartitions("book").mapInPandas(_union, "node long, root long")
    small = edges.join(large, "book", "left_anti").repartition("book").sortWithinPartitions("book").mapInPandas(_union, "node long, root long")
    rest = edges.join(large, "book", "left_semi")
    both = cut_lineage(rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("least"))
        step = labels.join(around, labels["node"] == around["a"]).select("node", "root", F.least("root", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = cut_lineage(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "root"))
        labels = moved.select("node", F.col("new").alias("root"))
        if moved.filter("new <> root").isEmpty():
            return small.unionByName(labels)


def same_names(df: DataFrame, key: str, group: str, name: str, aliases: str, role: str, pronoun: str, target: str) -> DataFrame:
    """(``key``, ``entity``) for the rows of each group: ``entity`` is the smallest key of the rows that mean the same.

    Rows alike in all five fields are one node, so copies cost nothing.  Nodes of
    a group that share a block key are compared; sure pairs are joined to
    components.  A name that could be several people (a family name, an initial)
    goes to a component only if it is the only one that it fits.  Rows with a null
    group, or a null or blank name, stand alone.
    """
    rows = df.select(F.col(key).alias("key"), F.col(group).alias("book"), F.col(name).alias("name"), F.col(role).alias("role"), F.col(pronoun).alias("pronoun"), F.col(target).alias("target"))
    named = rows.filter(F.col("book").isNotNull() & F.col("name").rlike(r"(?U)\w"))
    mark = F.sha2(F.to_json(F.struct("book", "name", "role", "pronoun", "target")), 256)
    named = named.withColumn("mark", mark)
    fields = ["book", "name", "role", "pronoun", "target"]
    nodes = named.groupBy("mark", *fields).agg(F.min("key").alias("node"))
    nodes = cut_lineage(nodes.select("node", "mark", *fields).mapInPandas(_parse_rows, _NODE))
    packed = split_packed(df.filter(F.col(aliases).rlike("[“\"「]")).select(F.struct(F.col(group).alias("g"), F.col(key).alias("k")).alias("_g"), F.col(aliases).alias("_a")), "_g", "_a", "text")
    quoted = packed.select(F.col("_g.g").alias("book"), "text").unionByName(nodes.select("book", F.col("name").alias("text")))
    quoted = quoted.filter(F.col("text").rlike("[“\"「]") & F.col("book").isNotNull()).distinct()
    pets = quoted.mapInPandas(_pets, "book long, first string, nick string").distinct()
    pets = pets.groupBy("book", "first").agg(F.collect_set(F.concat_ws("\t", "first", "nick")).alias("pets"))
    parsed = nodes.drop("mark", "name").join(pets, ["book", "first"], "left")
    keyed = parsed.select("book", "node", F.explode("codes").alias("code"))
    close = (
        keyed.alias("a")
        .join(keyed.alias("b"), (F.col("a.book") == F.col("b.book")) & (F.col("a.code") == F.col("b.code")) & (F.col("a.node") < F.col("b.node")))
        .select(F.col("a.node").alias("node_a"), F.col("b.node").alias("node_b"))
        .distinct()
    )
    fields = [c for c in parsed.columns if c not in ("codes", "book", "pets")]
    left = parsed.select("book", F.col("pets").alias("pets_a"), *(F.col(c).alias(f"{c}_a") for c in fields))
    right = parsed.select(F.col("pets").alias("pets_b"), *(F.col(c).alias(f"{c}_b") for c in fields))
    empty = F.array().cast("array<string>")
    pairs = close.join(left, "node_a").join(right, "node_b").withColumn("pets", F.array_union(F.coalesce("pets_a", empty), F.coalesce("pets_b", empty))).drop("pets_a", "pets_b")
    graded = cut_lineage(pairs.mapInPandas(_compare_rows, "book long, a long, b long, grade int, weak int"))
    roots = cut_lineage(components(graded.filter("grade = 2")))
    roots = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    # Uncertain pairs, from the uncertain name's side: taken where all that it fits is one component.
    doubt = graded.filter("grade = 1").select("book", F.when(F.col("weak") == 1, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(F.col("weak") == 1, F.col("a")).otherwise(F.col("b")).alias("other"))
    fits = doubt.join(roots, "node").withColumnRenamed("root", "own").join(roots.select(F.col("node").alias("other"), "root"), "other").filter("own <> root")
    # A component of uncertain names moves as one.
    only = fits.groupBy("book", "own").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo = hi").select("book", F.col("own").alias("a"), F.col("lo").alias("b"))
    merged = components(only)
    final = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("entity"))
    linked = named.select("key", "mark").join(nodes.select("mark", "node"), "mark").join(final, "node")
    first = linked.groupBy("entity").agg(F.min("key").alias("least"))
    linked = linked.join(first, "entity").select(F.col("key").alias(key), F.col("least").alias("entity"))
    alone = rows.filter(F.col("book").isNull() | ~F.coalesce(F.col("name").rlike(r"(?U)\w"), F.lit(False))).select(F.col("key").alias(key), F.col("key").alias("entity"))
    return linked.unionByName(alone)


def same_name_pairs(entities: DataFrame, key: str) -> DataFrame:
    """(``first``, ``second``) for all pairs of rows of one entity, the smaller key first."""
    entities = cut_lineage(entities)
    several = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("entity")
    rows = entities.join(several, "entity", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))).select(F.col(f"a.{key}").alias("first"), F.col(f"b.{key}").alias("second"))
