"""Text expressions: clean-up, script counts, sentence splitting, token estimates."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
CJK = "[一-鿿]"
SCRIPTS = {"cjk": CJK, "letters": r"\p{L}"}
ENDERS = "。！？!?…"
CLOSERS = "”’」』）)]\"'"
CLAUSE_BREAKS = "，,、；;"
ENTITIES = {
    "nbsp": " ",
    "#160": " ",
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "#39": "'",
    "#x27": "'",
}

# Python's notion of white space, for Java regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def char_class(chars: str) -> str:
    """A regular-expression class of exactly these characters."""
    return "[" + "".join("\\" + c if c in "[]^-\\&\"'()" else c for c in chars) + "]"


def once(col: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``col`` once and use its value several times inside one expression."""
    return F.get(F.transform(F.array(col), use), 0)


def count_cjk(col: Column) -> Column:
    return F.regexp_count(col, F.lit(CJK)).cast("long")


def count_script(col: Column, script: str = "cjk") -> Column:
    return F.regexp_count(col, F.lit(SCRIPTS[script])).cast("long")


def has_script(col: Column, script: str = "cjk", minimum: int = 1) -> Column:
    """Whether ``count_script`` reaches ``minimum``; the search ends as soon as it does."""
    one = SCRIPTS[script]
    other = one.replace("\\p", "\\P") if one.startswith("\\p") else "[^" + one[1:]
    return col.rlike(rf"\A(?:{other}*+{one}){{{minimum}}}")


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(col, F.lit(WHITE))


def is_blank(col: Column) -> Column:
    return F.coalesce(~col.rlike("[^" + SPACE[1:]), F.lit(True))


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def clean_web_text(col: Column) -> Column:
    """One space between words, none at the ends, then no ``·`` or ``:`` at the ends."""
    spaced = F.trim(F.regexp_replace(col, f"{SPACE}+", " "))
    return F.regexp_replace(spaced, r"^[·:]+|[·:]+\z", "")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


# Letters, digits and marks that NFKC leaves alone whatever stands next to them.
_NFKC_STABLE = r"^[\x00-\x7f¡-§©«¬®°±¶·»¿À-ı一-鿿。、〈-】‘-”—]*\z"


def nfkc(col: Column) -> Column:
    """NFKC has no Spark function; only texts it could change travel to Python (as Arrow)."""
    stable = col.rlike(_NFKC_STABLE)
    return F.when(stable, col).otherwise(_nfkc(F.when(~stable, col)))


def clean(col: Column) -> Column:
    """Clean an article body for sentence work; null and empty give an empty string.

    Order matters: control characters, entities, NFKC, then all format and control characters,
    which also removes line breaks.
    """
    out = F.coalesce(col, F.lit(""))
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    pattern = "&(?i:" + "|".join(ENTITIES) + ");"
    out = once(
        out,
        lambda t: F.when(
            t.contains("&"), _decode(t, pattern, lambda e: F.element_at(known, F.lower(e)))
        ).otherwise(t),
    )
    out = nfkc(out)
    out = F.regexp_replace(out, r"[\p{Cf}\p{Cc}]", "")
    return strip(F.regexp_replace(out, r"[ \t\r\f\x0b]+", " "))


def _decode(col: Column, pattern: str, value) -> Column:
    """Replace every match of an ``&name;`` pattern by ``value(name)``; unknown names stay."""
    pieces = F.split(col, pattern)
    marks = F.regexp_extract_all(col, F.lit("(" + pattern + ")"), F.lit(1))
    joined = F.zip_with(
        pieces,
        marks,
        lambda piece, mark: F.concat(
            piece,
            F.when(mark.isNull(), "").otherwise(
                F.coalesce(value(F.substring(mark, F.lit(2), F.length(mark) - 2)), mark)
            ),
        ),
    )
    return F.array_join(joined, "")


def _code_point(number: Column) -> Column:
    ok = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def unescape(col: Column) -> Column:
    """Decode HTML character references: numeric ones, and the named ones of HTML 4."""
    table = " ".join(f"{name}={chr(code)}" for name, code in sorted(name2codepoint.items()))
    known = F.str_to_map(F.lit(table + " apos='"), F.lit(" "), F.lit("="))

    def value(name: Column) -> Column:
        digits = F.regexp_replace(name, "^#[xX]?", "")
        return (
            F.when(name.rlike("^#[xX]"), _code_point(F.conv(digits, 16, 10).cast("long")))
            .when(name.startswith("#"), _code_point(digits.try_cast("long")))
            .otherwise(F.element_at(known, name))
        )

    pattern = "&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"
    return once(col, lambda t: F.when(t.contains("&"), _decode(t, pattern, value)).otherwise(t))


def sentence_array(
    col: Column, enders: str = ENDERS, script: str = "cjk", minimum: int = 2
) -> Column:
    """Sentences in order; enders and closing marks stay, sentences without script are dropped."""
    end = char_class(enders)
    other = "[^" + end[1:]
    tail = char_class(enders + CLOSERS)
    pattern = f"{other}*{end}{tail}*|{other}+\\z"
    lines = F.split(F.regexp_replace(F.coalesce(col, F.lit("")), r"\r\n?", "\n"), "\n")
    parts = F.flatten(
        F.transform(lines, lambda line: F.regexp_extract_all(strip(line), F.lit(pattern), F.lit(0)))
    )
    return F.filter(F.transform(parts, strip), lambda s: has_script(s, script, minimum))


def est_tokens(col: Column, char_per_token: float = 2.0) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(col) / F.lit(char_per_token))).cast("long")


def split_long(col: Column, max_len: int) -> Column:
    """Pieces of at most ``max_len`` characters: whole clauses packed, longer clauses cut hard."""
    if max_len <= 0:
        return F.array().cast("array<string>")
    breaks = char_class(CLAUSE_BREAKS)
    clauses = F.regexp_extract_all(
        col, F.lit(f"[^{breaks[1:]}*{breaks}|[^{breaks[1:]}+\\z"), F.lit(0)
    )
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(acc: Column, clause: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(clause) <= max_len
        closed = F.concat(
            acc["done"], F.filter(F.array(acc["open"]), lambda piece: piece != "")
        )
        whole = F.floor((F.length(clause) - 1) / max_len).cast("int")
        cuts = F.transform(
            F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(
                F.array().cast("array<int>")
            ),
            lambda k: F.substring(clause, (k - 1) * max_len + 1, F.lit(max_len)),
        )
        rest = F.substring(clause, whole * max_len + 1, F.lit(max_len))
        return F.when(
            fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], clause).alias("open"))
        ).otherwise(F.struct(F.concat(closed, cuts).alias("done"), rest.alias("open")))

    packed = F.reduce(
        clauses, empty, pack, lambda acc: F.concat(acc["done"], F.array(acc["open"]))
    )
    return F.when(F.length(col) <= max_len, F.array(col)).otherwise(
        F.filter(packed, lambda piece: strip(piece) != "")
    )
