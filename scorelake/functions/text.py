"""Text clean-up and character counts of recognised lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width and look-alike characters and what they stand for.
WIDE_FROM = "１２３４５６７０．－｜丨│"
WIDE_TO = "12345670.-|||"

# The characters of notes, and the CJK range.
PITCH_CHARS = r"[1-7１-７]"
DIGIT_CHARS = r"[0-7１-７０]"
CJK = r"[\x{4e00}-\x{9fff}]"
PURE_TOKENS = r"^[0-7|\-–—.·•]+$"

# Keyword gates of the line classes.
ANNOTATION_WORDS = r"(?iu)(音高序列|pitch\s*sequence|\bgt\b|ground[\s-]?truth|子集)"
FOOTER_WORDS = r"(?iu)(来源|授权|cc0|copyright|©|issue\s*#|generate-eval|scripts/)"
META_WORDS = r"(?iu)(key|time|tempo|bpm|拍号|调\s*[:：]|速度|1\s*=\s*[A-Ga-g]|time\s*signature)"
VETO_WORDS = (
    r"(?iu)(key|time|tempo|bpm|拍号|调\s*[:：]|速度|title|样例|sample|授权|来源|"
    r"音高序列|pitch\s*sequence|\bgt\b|子集)"
)
TITLE_WORDS = r"(?iu)(title|样例|sample|eval\s*e\d|标题|示意)"
PURE_METER = r"^\s*[1-9][0-9]*\s*/\s*[1-9][0-9]*\s*$"
# How a line names its key, meter and tempo.
KEY_ANY = r"(?iu)(?:key|调)\s*[:：]?\s*([A-Ga-g][b#]?)|1\s*=\s*([A-Ga-g][b#]?)"
METER = r"(?iu)(?:time|拍号)?\s*[:：]?\s*([1-9][0-9]*)\s*/\s*([1-9][0-9]*)"
TEMPO = r"(?iu)(?:tempo|bpm|速度)\s*[:：]?\s*([1-9][0-9]{1,2})"


# The first two characters, in any case that Unicode folds, of the words above: elsewhere no word is looked for.
BEGIN_OF = {
    ANNOTATION_WORDS: "[音子pPgG][高集iIİıtTrR]",
    FOOTER_WORDS: "©|[来授cCiIİıgGsSſ][源权cCoOsSſeE]",
    META_WORDS: r"[kK\u212atTbB拍调速1][eEiIİıpP号度\s=:：]",
    TITLE_WORDS: "[tTsSſeE样标示][iIİıaAvV例题意]",
}


def names(text: Column, words: str) -> Column:
    """Whether a text holds one of ``words``, a key of ``BEGIN_OF``."""
    return text.rlike(f"(?={BEGIN_OF[words]}){words}")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    """Trim all white space, the ideographic space included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trimmed(text: Column) -> Column:
    """:func:`strip`, which looks through a text only where its ends are white space."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), strip(text)).otherwise(text)


def plain(text: Column) -> Column:
    """Full-width characters to ASCII, trimmed."""
    return strip(F.translate(text, WIDE_FROM, WIDE_TO))


def plain_bars(text: Column) -> Column:
    """Bar look-alikes between pitch digits become bars; repeated bars collapse."""
    fixed = F.regexp_replace(text, r"(?U)(?<=[0-7])\s*[Il丨│]\s*(?=[0-7\-])", " | ")
    return F.regexp_replace(fixed, r"\|{2,}", "|")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def is_pure(text: Column) -> Column:
    """Whether a text holds nothing but ``PURE_TOKENS`` and white space."""
    token = PURE_TOKENS[2:-3]
    return text.rlike(rf"(?U)^\s*[{token}][{token}\s]*$")


def key_in(text: Column) -> Column:
    """First key named in a line, letter case put right; null when none."""
    first = F.coalesce(
        F.nullif(F.regexp_extract(text, KEY_ANY, 1), F.lit("")),
        F.nullif(F.regexp_extract(text, KEY_ANY, 2), F.lit("")),
    )
    return F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 1)))


def meter_in(text: Column) -> Column:
    num, den = F.regexp_extract(text, METER, 1), F.regexp_extract(text, METER, 2)
    return F.when(num != "", F.concat(num, F.lit("/"), den))


def tempo_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, TEMPO, 1), F.lit("")).cast("double")


def title_in(text: Column, longest: int | None = None) -> Column:
    """Title named by a line (text after the first colon, or the marked line), cut to ``longest`` characters if given."""
    cut = (lambda v: v) if longest is None else (lambda v: F.substring(v, 1, longest))
    named = strip(F.regexp_replace(text, r"^[^:：]*[:：]", ""))
    return F.when(text.rlike(r"(?iu)title\s*[:：]"), cut(named)).when(
        text.contains("样例") | text.contains("Sample"), cut(text)
    )


def is_pitch_line(text: Column) -> Column:
    digits = count_of(text, "[1-7]")
    cjk = count_of(text, CJK)
    clear_run = text.rlike(r"[1-7].*[1-7].*[1-7]") & text.contains("|")
    meterish = (
        text.rlike(r"\d+\s*/\s*\d+")
        & (digits <= 2)
        & ~text.contains("|")
        & ~text.rlike(r"[1-7]\s*[1-7]")
    )
    return (
        (~text.rlike(VETO_WORDS) | clear_run)
        & (digits >= 2)
        & ~text.rlike(PURE_METER)
        & ~meterish
        & ~((cjk >= 4) & (digits < cjk))
    )


def is_lyric_line(text: Column) -> Column:
    return (count_of(text, CJK) >= 2) & (count_of(text, "[1-7]") <= 1)


def normal_key(key: Column) -> Column:
    k = F.replace(F.replace(strip(F.coalesce(key, F.lit(""))), F.lit("♭"), F.lit("b")), F.lit("♯"), F.lit("#"))
    k = F.regexp_replace(k, "^1=", "")
    return F.concat(F.upper(F.substring(k, 1, 1)), F.substr(k, F.lit(2)))


def normal_meter(meter: Column) -> Column:
    m = F.coalesce(meter, F.lit(""))
    num = F.regexp_extract(m, r"(\d+)\s*/\s*(\d+)", 1)
    den = F.regexp_extract(m, r"(\d+)\s*/\s*(\d+)", 2)
    return F.when(num != "", F.concat(num, F.lit("/"), den)).otherwise(strip(m))
