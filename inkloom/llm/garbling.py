"""Garbled text from wrong character encoding.

Round-trip repair: garbled passages are encoded again under a candidate legacy
encoding and strictly decoded as what they were; this is repeated for nested
layers, and a step is taken only when the cost of garbling drops.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Single-byte encodings in which UTF-8 may have been read.
LEGACY = ("latin-1", "cp1252", "mac_roman", "cp1251", "cp1250", "cp437", "cp850", "cp1254", "iso8859_15", "cp866", "koi8_r")
# Fixed values: (read as, written as) among single-byte encodings.
SWAPS = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1250", "cp1252"), ("cp1251", "cp1252"))
_QUOTES_OPEN, _QUOTES_CLOSE = "“‘„«", "”»"
_USUAL = set("“”‘’„«»—–…·€£¥§°¿¡•™®©×÷†‡′″←→★☆♪♥")


def _byte_table(codec: str) -> dict[str, int]:
    """Character to byte; bytes that the codec leaves open stand for the control of the same number."""
    out = {}
    for b in range(256):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


_BYTES = {codec: _byte_table(codec) for codec in {*LEGACY, *(c for pair in SWAPS for c in pair)}}
_CHARS = {codec: {b: c for c, b in table.items()} for codec, table in _BYTES.items()}


def _utf8_pattern(codec: str) -> regex.Pattern:
    """Runs of characters whose bytes in ``codec`` have the shape of UTF-8 sequences."""
    chars = _CHARS[codec]

    def some(low: int, high: int) -> str:
        return "[" + "".join(regex.escape(chars[b], special_only=False) for b in range(low, high + 1)) + "]"

    tail = some(0x80, 0xBF)
    return regex.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{tail}|{some(0xF0, 0xF4)}{tail}{tail}{tail})+")


_UTF8 = {codec: _utf8_pattern(codec) for codec in LEGACY}

#: Texts that may be garbled: at a foreign character, another one beside it, a control or replacement character, a
#: symbol, a capital after a small letter, or a letter that a quotation mark or dash may have become.  Everything is
#: asked at the foreign character, so a pattern that meets none passes over plain text at once.
SUSPECT = (
    r"[^\x00-\x7f](?:(?=[^\x00-\x7f])|(?<=[\x80-\x9f�ìîíëÒÓÕÐ†‡•‹›»«¿¡])|(?<=[[\p{S}\p{C}]&&[^€\xad]])|(?<=\p{Ll}\p{Lu})|(?<=\p{Lu}\p{Lu})(?=\p{Ll})"
    r"|(?<=\p{L}–)(?=\p{L})|(?<=[.,!?]\p{L})|(?<=\p{L})(?<![\p{L}\p{N}].)(?![\p{L}\p{N}]))"
)


def cost(text: str) -> float:
    """How garbled a text looks; 0 for ordinary prose in any one script."""
    total, n = 0.0, len(text)
    for at, c in enumerate(text):
        if c < "\x80":
            continue
        before = text[at - 1] if at else " "
        after = text[at + 1] if at + 1 < n else " "
        if c == "�" or "\x80" <= c <= "\x9f":
            total += 3
        elif c.isalpha():
            total += _letter_cost(text, at, c, before, after)
        elif c in _USUAL:
            if c in "•™®©¥£¢" and before.isalpha():
                total += 1.2
            elif c == "–" and after.isalpha() and not before.isalnum():
                total += 1.2
            elif before.isalpha() and after.isalpha():
                total += 0.0 if c in "’—·" else 0.7 if c == "–" else 0.2 if c == "…" else 2
            elif c in _QUOTES_OPEN and (before.isalpha() or before in ".,!?" or after.isspace()):
                total += 1.5
            elif c in _QUOTES_CLOSE and (before.isspace() or after.isalpha()):
                total += 1.5
            elif c in "®©™" and after.isalpha():
                total += 2
        elif "\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uffef":
            pass
        elif unicodedata.category(c) in ("Mn", "Zs", "Pd", "Ps", "Pe"):
            total += 0.3
        else:
            total += 2
    return total


def _letter_cost(text: str, at: int, c: str, before: str, after: str) -> float:
    later = text[at + 2] if at + 2 < len(text) else " "
    script = _script(c)
    if script != "l":
        # Scripts mixed within a word.
        return 2.0 if (before.isalpha() and _script(before) == "l") or (after.isalpha() and _script(after) == "l") else 0.0
    total = 0.0
    if c.isupper():
        if before.islower():
            total += 2
        elif before in ".,!?…":
            total += 2
        elif after.isupper() and later.islower() and not before.isalpha():
            total += 2
        elif before.isupper() and after.islower():
            total += 1.5
        elif after.isupper() and later in " ’'Õ" and not before.isalpha():
            total += 1  # a capital before a one-letter word
        elif not before.isalpha() and not after.isalpha():
            total += 0.6
        elif after and not after.isalpha() and not before.isalpha():
            total += 0.6
        if after > "\x7f" and after.isalpha() and after.islower() and not before.isalpha():
            total += 0.8
    else:
        if not before.isalpha() and after.isupper():
            total += 2
        elif before in ".,!?…" and not after.isalpha():
            total += 2
        elif before in ".,!?…":
            total += 1
        elif not before.isalpha() and not after.isalpha():
            total += 0.6
        elif before.isupper() and after.isupper():
            total += 1.5
        elif c in "ƒªºµ" and before.isalpha():
            total += 1.5
        elif before == "n" and after == "t" and _ending(text, at + 1):
            total += 1.2
        elif c in "íÍ" and before.isalpha() and after in "tsdmrvl" and _ending(text, at + 1):
            total += 1.2
        elif c in "óñ" and _dash_like(text, at):
            total += 0.7
    return total


def _ending(text: str, at: int) -> bool:
    """Whether what stands at ``at`` is the end of a contraction or possessive."""
    end = at
    while end < len(text) and text[end].isalpha():
        end += 1
    return text[at:end] in ("t", "s", "d", "m", "re", "ve", "ll")


def _dash_like(text: str, at: int) -> bool:
    """A letter between two stretches of at least three letters of a very long word."""
    left = at
    while left and text[left - 1].isalpha():
        left -= 1
    right = at + 1
    while right < len(text) and text[right].isalpha():
        right += 1
    return at - left >= 3 and right - at - 1 >= 3 and right - left >= 9


def _script(c: str) -> str:
    """Latin or not; enough to see mixtures."""
    return "l" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else "x"


def _undo_utf8(text: str, codec: str) -> str:
    """Runs that read as UTF-8 in the bytes of ``codec``, decoded strictly where that lowers the cost around them."""
    table = _BYTES[codec]

    def decoded(found: regex.Match) -> str:
        run = found[0]
        try:
            plain = bytes(table[c] for c in run).decode("utf-8")
        except UnicodeDecodeError:
            return run
        left, right = text[max(0, found.start() - 3) : found.start()], text[found.end() : found.end() + 3]
        drop = cost(left + run + right) - cost(left + plain + right)
        # A sequence of three bytes, or a letter with a symbol after it, is a sign by itself.
        sign = len(run) > 2 * len(plain) or not run[1].isalpha()
        usual = all(c < "ɐ" or "\u2000" <= c <= "\u20cf" for c in plain)
        return plain if drop > 0.5 or (drop >= 0 and sign and (usual or not run.isalpha())) else run

    return _UTF8[codec].sub(decoded, text)


_SWAP = {
    pair: {ord(read): _CHARS[pair[1]][b] for read, b in _BYTES[pair[0]].items() if b >= 0x80 and _CHARS[pair[1]][b] != read}
    for pair in SWAPS
}
# The same mistake made twice over shows no drop half-way, so it is also undone in one step.
_SWAP |= {(pair[0], pair[1], "twice"): {k: chr(v) if isinstance(v := table.get(ord(c), c), int) else v for k, c in table.items()} for pair, table in list(_SWAP.items())[:2]}


def _undo_swap(text: str, pair: tuple[str, ...]) -> str:
    """``text`` as bytes of one single-byte encoding read in another, where the cost drops: as a whole, else by paragraph, else by sentence."""
    table = _SWAP[pair]

    def attempt(part: str, units: tuple[str, ...]) -> str:
        now = cost(part)
        if now < 1:
            return part
        changed = part.translate(table)
        if changed != part:
            then = cost(changed)
            if then <= now - 1 and then <= 0.4 * now:
                return changed
        if not units:
            return part
        pieces = regex.split(r"(\n\s*\n)", part) if units[0] == "paragraph" else regex.split(r"(?<=[.!?…”\"ÓîÖÉ])(\s+)", part)
        return "".join(attempt(p, units[1:]) for p in pieces) if len(pieces) > 1 else part

    return attempt(text, ("paragraph", "sentence"))


def repair(text: str) -> tuple[str, int, bool]:
    """The text restored as far as possible, the number of layers undone, and whether signs of garbling remain.

    Every layer undone makes the text shorter or its cost lower, so this ends
    however many layers there are.
    """
    layers = 0
    while True:
        now, best, best_cost = cost(text), text, None
        if now == 0 and text.isascii():
            break
        for codec in LEGACY:
            if _UTF8[codec].search(text):
                tried = _undo_utf8(text, codec)
                # The encoding that accounts for most characters; by the order above where several do.
                if len(tried) < len(best):
                    best, best_cost = tried, cost(tried)
        if best_cost is None and now >= 1:
            for pair in _SWAP:
                tried = _undo_swap(text, pair)
                if tried != text and (best_cost is None or cost(tried) < best_cost):
                    best, best_cost = tried, cost(tried)
        if best_cost is None:
            break
        text, layers = best, layers + 1
    return text, layers, any(c == "�" or "\x80" <= c <= "\x9f" for c in text)


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [repair(t) for t in batch["text"]]
        yield pd.DataFrame(
            {"key": batch["key"], "restored": [o[0] for o in out], "layers": pd.array([o[1] for o in out], "int32"), "damaged": [o[2] for o in out]}
        )


def repair_encoding(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``df``: ``key``, ``restored``, ``layers``, ``damaged``, ``garbled``.

    ``layers`` counts the wrong decodings undone, ``damaged`` tells of characters
    lost for good, ``garbled`` is true for either.  A row is decided on its own;
    rows without any suspect character, null and empty ones among them, pass
    unchanged and never leave the JVM.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    suspect = F.coalesce(F.col("text").rlike(SUSPECT), F.lit(False))
    sound = rows.filter(~suspect).select("key", F.col("text").alias("restored"), F.lit(0).alias("layers"), F.lit(False).alias("damaged"))
    odd = rows.filter(suspect).mapInPandas(_repairs, "key long, restored string, layers int, damaged boolean")
    return sound.unionByName(odd).withColumn("garbled", (F.col("layers") > 0) | F.col("damaged")).withColumnRenamed("key", key)


def garbled_keys(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(``table_name``, ``row_key``) of the rows that hold a wrongly decoded passage."""
    found: Column = F.col("garbled")
    return repair_encoding(df, key, text).filter(found).select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"))
