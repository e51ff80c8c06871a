"""Text functions as Column expressions: Unicode rules of Python strings, terms, phrases, signals."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle import config

SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_WORD = r"\p{L}\p{N}_"
CJK = "[一-鿿]"
_SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(_SPACES))


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{SPACE[1:]}")


def one_line_end(c: Column) -> Column:
    """Every kind of line end as a newline."""
    return F.regexp_replace(c, _LINE, "\n")


def lines(c: Column) -> Column:
    """Lines at every Unicode line end; no empty line after a last line end."""
    parts = F.split(c, _LINE)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Each accented letter of the basic plane whose first part is a letter or digit, and that part."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x10000) if not 0xAC00 <= c < 0xD7A4 and (d := unicodedata.normalize("NFD", chr(c))) != chr(c) and d[0].isalnum() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    plain = F.lower(c)
    return F.when(~plain.rlike(r"[^\x00-\x7F]"), plain).otherwise(F.translate(F.regexp_replace(plain, r"\p{Mn}", ""), *_accents()))


def terms(c: Column) -> Column:
    """Runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def index_text(c: Column, segment=None) -> Column:
    """Text with spaces between words for indexing and querying alike. A run of CJK characters is cut by ``segment`` (Column
    of a run -> Column of a spaced run), by default into single characters; other parts keep their white-space words."""
    if segment is None:
        spaced = F.regexp_replace(c, f"({CJK})", " $1 ")
    else:
        runs = F.split(F.regexp_replace(c, f"({CJK}+)", "\u0000$1\u0000"), "\u0000")
        spaced = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^{CJK}+$"), segment(r)).otherwise(r)), " ")
    return strip(F.regexp_replace(spaced, f"{SPACE}+", " "))


def phrases(query: Column) -> Column:
    """The phrases that a query matches any of: the terms of each white-space token; tokens without terms match nothing."""
    tokens = F.filter(F.split(query, f"{SPACE}+"), lambda t: t != "")
    return F.filter(F.transform(tokens, terms), lambda p: F.size(p) > 0)


def graph_normal(c: Column) -> Column:
    """Lower-case words, dots and hyphens, single spaces between."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), rf"[^{_WORD}.\-]+", " "), f"{SPACE}+", " "))


def cjk_runs(c: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({CJK}{{{least},}})"), 1)


def contains_phrase(query: Column, alias: Column) -> Column:
    """Both normalised. An alias with long CJK runs is contained if one of them is; any other as whole words."""
    runs = cjk_runs(alias, config.MIN_CJK_RUN)
    words = F.contains(F.concat(F.lit(" "), query, F.lit(" ")), F.concat(F.lit(" "), alias, F.lit(" ")))
    return F.when(alias == "", False).when(F.size(runs) > 0, F.exists(runs, lambda r: F.contains(query, r))).otherwise(words)


def lexical_signal(query: Column) -> Column:
    """Whether a query names code: back-ticks, snake case, camel case or an acronym."""
    return (
        query.rlike("`[^`]+`") | query.rlike("[A-Za-z0-9]+_[A-Za-z0-9]+") | query.rlike("[a-z][A-Z]") | query.rlike(rf"(?<![{_WORD}])[A-Z]{{2,}}(?![{_WORD}])")
    )


def synonym(c: Column) -> tuple[Column, Column]:
    """The text rewritten by the first synonym it contains, and whether it contains one."""
    found = [(F.contains(c, F.lit(k)), F.replace(c, F.lit(k), F.lit(v[0]))) for k, v in config.SYNONYMS.items()]
    rewritten = reduce(lambda acc, kv: F.when(kv[0], kv[1]).otherwise(acc), reversed(found), c)
    return rewritten, reduce(lambda a, b: a | b, [k for k, _ in found])


def chunk_key(doc_id: Column, heading_path: Column, idx: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", doc_id, F.array_join(heading_path, "/"), idx.cast("string"))), 1, 16)


def snippet(chunk_id: Column, doc_id: Column, page: Column, text: Column) -> Column:
    """One line: id, document, page and the beginning of the text."""
    squashed = strip(F.regexp_replace(text, f"{SPACE}+", " "))
    head = F.when(F.length(squashed) > 80, F.concat(F.substring(squashed, 1, 80), F.lit("…"))).otherwise(squashed)
    return F.concat_ws(" · ", chunk_id, doc_id, F.concat(F.lit("p"), F.coalesce(page.cast("string"), F.lit("?"))), head)


def rows_whole(text: Column) -> Column:
    """Whether each line from the first table line on begins and ends with a bar."""
    trimmed = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    first = F.array_position(F.transform(trimmed, lambda x: F.startswith(x, F.lit("|"))), True)
    body = F.when(first > 0, F.slice(trimmed, first.cast("int"), F.size(trimmed))).otherwise(F.array().cast("array<string>"))
    return (F.size(body) > 0) & F.forall(body, lambda x: F.startswith(x, F.lit("|")) & F.endswith(x, F.lit("|")))


def degrade(*codes: Column) -> Column:
    """Codes that are set, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*codes))))


