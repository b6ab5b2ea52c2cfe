"""Text keys as column expressions. All run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a regex class body and as plain characters.
WS = (r" \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

CYRILLIC = r"[\x{400}-\x{4FF}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(_col(c), F.lit(WS_CHARS))


def squeeze(c: Column | str) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"[{WS}]+", " "))


def location_key(c: Column | str) -> Column:
    """Key under which places, regions, groups and directions are matched."""
    bare = F.translate(F.lower(F.coalesce(_col(c), F.lit(""))), "'’", "")
    return squeeze(F.translate(F.replace(bare, F.lit("the"), F.lit("")), "-–—", "   "))


def text_key(c: Column | str) -> Column:
    """Lower-cased text without apostrophes, dashes as blanks."""
    return F.lower(F.translate(F.coalesce(_col(c), F.lit("")), "-‒–—'’‘ʼ", "    "))


def phrase_key(c: Column | str) -> Column:
    return squeeze(text_key(c))


def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """All code points with a compatibility decomposition: those with one base letter, and the others with their text.

    Hangul syllables stay whole: taken apart, they hold no accents.
    """
    src, dst, longer = [], [], {}
    for code in (*range(0xA0, 0xAC00), *range(0xF900, 0x110000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if base == chr(code) or not base:
            continue
        if len(base) == 1:
            src.append(chr(code))
            dst.append(base)
        else:
            longer[chr(code)] = base
    return "".join(src), "".join(dst), longer


_ACCENTED, _PLAIN, _LONGER = _accent_tables()
_LONGER_CLASS = "[" + "".join(_LONGER) + "]"


def _spelled_out(s: Column) -> Column:
    """Ligatures and the like as several letters; only texts that have one are taken apart."""
    table = F.create_map(*(F.lit(x) for pair in _LONGER.items() for x in pair))
    return F.when(s.rlike(_LONGER_CLASS), F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(table[c], c)), "")).otherwise(s)


def accent_free(c: Column | str) -> Column:
    """Trimmed lower text without accents; ligatures, full-width and other compatibility forms as plain letters."""
    s = F.translate(F.lower(strip(F.coalesce(_col(c), F.lit("")))), _ACCENTED, _PLAIN)
    s = F.regexp_replace(_spelled_out(s), r"\p{Mn}", "")
    return squeeze(F.translate(s, "’`–", "''-"))


def alias_key(c: Column | str) -> Column:
    """Key that decides whether an alias is new."""
    return squeeze(F.translate(F.lower(F.coalesce(_col(c), F.lit(""))), "-'’", " "))


def compare_key(c: Column | str) -> Column:
    """Key for comparing canonical names. Case is kept."""
    s = F.regexp_replace(F.coalesce(_col(c), F.lit("")), rf"[{WS}]*\([^)]*\)", "")
    return squeeze(F.translate(s, "-'’", " "))


def plain_key(c: Column | str) -> Column:
    return F.lower(strip(F.coalesce(_col(c), F.lit(""))))


def matches_alias(text: Column, name: Column, aliases: Column) -> Column:
    names = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_contains(F.transform(names, plain_key), plain_key(text))


def is_latin(c: Column | str) -> Column:
    c = _col(c)
    return F.coalesce((F.length(c) > 0) & ~c.rlike(CYRILLIC), F.lit(False))


def split_list(c: Column | str) -> Column:
    """``a; b`` to an array of trimmed, non-empty parts."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ";"), strip)
    return F.filter(parts, lambda x: x != "")


def pack_list(c: Column | str) -> Column:
    return F.array_join(F.filter(_col(c), lambda x: strip(x) != ""), ";")


def sorted_pack(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(_col(c))), ";")


# Latin form of each Russian letter.
CYRILLIC_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh",
    "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu",
    "я": "ya",
}


def cyrillic_to_latin(c: Column | str) -> Column:
    """Russian text in Latin letters; other characters stay."""
    s = F.regexp_replace(_col(c), rf"[ИиЫы][Йй](?=[{WS}-]|\z)", "y")
    s = F.regexp_replace(s, rf"(?<![^{WS}-])е", "ye")
    s = F.regexp_replace(s, rf"(?<![^{WS}-])Е", "Ye")
    one = {k: v for k, v in CYRILLIC_LATIN.items() if len(v) == 1}
    one |= {k.upper(): v.upper() for k, v in one.items()}
    for k, v in CYRILLIC_LATIN.items():
        if len(v) > 1:
            s = F.replace(s, F.lit(k), F.lit(v))
            s = F.replace(s, F.lit(k.upper()), F.lit(v.capitalize()))
    return F.translate(s, "".join(one) + "ъьЪЬ", "".join(one.values()))


def exonym_key(c: Column | str) -> Column:
    """The form in which spelling rules see a romanized name."""
    return squeeze(F.translate(F.lower(strip(_col(c))), "’", "'"))


def ruled_word(w: Column) -> Column:
    """Russian-style spelling of a word by its ending."""
    ivka = w.rlike(r"[bcdfghjklmnpqrstvwxyzi]ivka\z")
    return (F.when(ivka, F.regexp_replace(w, r"ivka\z", "ovka"))
            .when(w.endswith("ivska"), F.regexp_replace(w, r"ivska\z", "ovskaya"))
            .when(w.endswith("ivske"), F.regexp_replace(w, r"ivske\z", "ovskoye"))
            .otherwise(w))
