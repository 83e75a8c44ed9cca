"""What a title says of itself: a person, a label, a movement, or perhaps a work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veduta.functions.text import search_key_ascii, text_or_empty
from veduta.operators.rules import cascade, contains_any

#: Words that join the parts of a name, and separators of programmes.
NAME_JOINTS = ("de", "del", "da", "do", "di", "van", "von", "y", "la")
SEPARATORS = ("pausa", "intervalo", "intermedio", "segunda parte", "primera parte")
_WORD = r"\p{L}[\p{L}\p{N}_’'.\-]*"


def looks_like_person(c: Column) -> Column:
    """One to five words, each a joint of names or with a capital, and none of the marks of titles."""
    words = F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))
    capital = F.forall(words, lambda w: F.btrim(F.lower(w), F.lit(".")).isin(*NAME_JOINTS) | w.rlike(r"^\p{Lu}"))
    return ~c.rlike(r'[:·—–«»"]') & F.size(words).between(1, 5) & capital


def non_work_reason(c: Column, composed: Column) -> Column:
    """Why a title names no work, first rule that fits; null if it may name one. A name alone is an artist
    only where no composer is known."""
    t = F.trim(text_or_empty(c))
    return cascade(
        [
            (F.length(t) < 3, "empty_or_too_short"),
            (t.rlike(r"(?i)^(?:piano|viol[ií]n|viola|violonchelo|directora?|coro|orquesta|ensemble|voz|voces)\s*:"), "instrument_or_role_label"),
            (F.lower(t).isin(*SEPARATORS), "programme_separator"),
            (t.rlike(r"(?i)^(?:[ivxlcdm]+|\d+)[.)]\s") & ~t.rlike(r"(?i)\b(?:bwv|op\.?|hob\.?|rv)\b"), "movement_or_numbered_fragment"),
            (~composed & looks_like_person(t), "artist_or_attribution_name"),
            (t.rlike(r"^[A-Z]{2,6}$"), "ensemble_or_acronym"),
        ],
        F.lit(None).cast("string"),
    )


def group_key(c: Column) -> Column:
    """A title's key without spaces, for grouping the spellings of one production."""
    return F.replace(search_key_ascii(c), F.lit(" "), F.lit(""))


_CAPITAL = "A-ZÁÉÍÓÚÑÜ"
_NAME = rf"(?:[{_CAPITAL}][A-Za-zÁÉÍÓÚÑÜáéíóúñü'’-]+|[{_CAPITAL}]\.)"
_ROLES = "director|directora|soprano|tenor|bar[ií]tono|mezzosoprano"
#: Keys of headers that no pattern tells.
HEADERS = ("w byrd", "joven orquesta de canarias jocan")


def header_like(c: Column) -> Column:
    """Two to four names or initials with capitals and nothing else."""
    return F.trim(text_or_empty(c)).rlike(rf"^{_NAME}(?:\s+{_NAME}){{1,3}}$")


def debris_reason(c: Column) -> Column:
    """Why a title is debris of its page, before any work is looked up; null if it may be a work."""
    t = F.trim(text_or_empty(c))
    return cascade(
        [
            (search_key_ascii(t).isin(*HEADERS), "composer_or_ensemble_header"),
            (t.rlike(r"(?iu)^(?:piano|director(?: musical| orquesta)?|voz|soprano|tenor|bar[ií]tono|mezzosoprano)\s*:"), "artist_or_role_credit"),
            (t.contains(",") & t.rlike(rf"(?iu)\b(?:{_ROLES}|solista|voz)\b"), "artist_or_role_credit"),
            (t.rlike("^[A-ZÁÉÍÓÚÑ]\\.\\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+$"), "person_or_composer_header"),
            (t.rlike(r"(?i)^(?:arr\.?|arreglo|arrangement)(?![\p{L}\p{N}_])"), "arrangement_annotation"),
        ],
        F.lit(None).cast("string"),
    )


#: Productions by the words of a title's key that tell them, in order of precedence.
PRODUCTIONS = (
    ("figaro", ("figaro", "marriage")), ("barbiere", ("barbero", "barbiere")), ("manon", ("manon",)), ("blood", ("blood wedding", "bodas de sangre")), ("matthew", ("matthew", "pasion")),
    ("richard", ("richard", "riccardo")), ("john", ("saint john", "san giovanni")), ("bluebeard", ("bluebeard", "barbazul")), ("messiah", ("messiah", "mesias")), ("bayreuth", ("bayreuth",)),
    ("chamber", ("chamber music", "domingos de camara")),
)


def production_group(c: Column) -> Column:
    """The production that a title names, or its key without spaces."""
    key = search_key_ascii(c)
    return cascade([(contains_any(key, *words), name) for name, words in PRODUCTIONS], group_key(c))
