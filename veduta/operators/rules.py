"""Ordered rules: the first that fits decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veduta.functions.text import clean_label, search_key_ascii, search_key_unicode


def cascade(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Value of the first rule whose condition is true; a null condition does not fit."""
    out = None
    for condition, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, v) if out is None else out.when(condition, v)
    assert out is not None
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def contains_any(c: Column, *parts: str) -> Column:
    out = c.contains(parts[0])
    for p in parts[1:]:
        out = out | c.contains(p)
    return out


#: Canonical event types.
EVENT_TYPES = ("opera", "operetta", "ballet", "concert", "chamber_music", "recital", "children_family", "matinee", "other")


def canonical_event_type(raw: Column) -> Column:
    """Event type of a source's label, the first rule that fits; ``other`` if none does.

    Words are sought in the search key, so accents do not matter. Labels of opera and of concerts
    come first, so ``children_s_opera`` is an opera and ``chamber_music`` a concert."""
    value = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    key = search_key_unicode(value)
    return cascade(
        [
            (contains_any(key, "operette"), "operetta"),
            (contains_any(key, "opera", "music drama", "drame musical", "festival ring"), "opera"),
            (contains_any(key, "recit"), "recital"),
            (contains_any(key, "concert", "symphony", "symphonie", "chamber"), "concert"),
            (contains_any(key, "ballet", "dance"), "ballet"),
            (contains_any(value, "operetta"), "operetta"),
            (value.isin("musique_de_chambre", "musique_de_chambre_compositrices_d_hier"), "chamber_music"),
            (contains_any(value, "matin"), "matinee"),
            (value.isin(*EVENT_TYPES), value),
        ],
        "other",
    )


def ingested_event_type(label: Column) -> Column:
    """Event type of a Spanish or Italian label, in the five types that ingestion knows."""
    key = search_key_ascii(label)
    return cascade(
        [
            (contains_any(key, "opera", "lirica", "oratorio"), "opera"),
            (contains_any(key, "danza", "ballet"), "dance"),
            (contains_any(key, "recital"), "recital"),
            (contains_any(key, "concierto", "camara", "sinfoni"), "concert"),
            (contains_any(key, "flamenco"), "dance"),
        ],
        "other",
    )


def calendar_event_type(label: Column, title: Column) -> Column:
    """Event type by the words of a German or English calendar's label and title."""
    key = F.lower(F.concat_ws(" ", label, title))
    return cascade(
        [
            (contains_any(key, "matinee", "matinée"), "matinee"),
            (contains_any(key, "geheimmission", "kinder", "children", "familien", "family"), "children_family"),
            (contains_any(key, "fledermaus", "operette"), "operetta"),
            (contains_any(key, "oper"), "opera"),
            (contains_any(key, "ballett", "ballet"), "ballet"),
            (contains_any(key, "konzert", "concert"), "concert"),
        ],
        "other",
    )


#: Activities that are no performances, by the words that tell them, first match first.
ACTIVITIES = (("workshop", "workshop"), ("open class", "open_class"), ("opera ball", "opera_ball"), ("opernball", "opera_ball"), ("guided tour", "guided_tour"), ("führung", "guided_tour"))


def calendar_classification(label: Column, title: Column) -> Column:
    """The activity that label or title names, or else the event type."""
    key = F.lower(F.concat_ws(" ", label, title))
    return cascade([(key.contains(word), name) for word, name in ACTIVITIES], calendar_event_type(label, title))


#: Functions of a production by their German label: whole, then as part of a label.
PRODUCTION_LABELS = {"musikalische leitung": "conductor", "dirigent": "conductor", "conductor": "conductor"}
PRODUCTION_PARTS = {
    "inszenierung": "stage_director", "regie": "stage_director", "bühne": "set_designer", "kostüm": "costume_designer",
    "licht": "lighting_designer", "video": "video_designer", "dramaturg": "dramaturg",
}


def production_function(label: Column) -> Column:
    """Function in a production that a credit's label names; null for roles on stage."""
    key = F.lower(F.trim(label))
    return cascade([*[(key == k, v) for k, v in PRODUCTION_LABELS.items()], *[(key.contains(k), v) for k, v in PRODUCTION_PARTS.items()]], F.lit(None).cast("string"))


#: Artistic roles by the beginning of their label's key, first match first.
ARTISTIC_ROLES = (
    ("direccion musical", "Conductor"), ("direccion de escena", "Stage Director"), ("director de escena", "Stage Director"), ("escenografia", "Sets"),
    ("vestuario", "Costumes"), ("iluminacion", "Lighting"), ("direccion del coro", "Chorus Master"), ("director del coro", "Chorus Master"),
    ("coreografia", "Choreography"), ("dramaturgia", "Dramaturgy"), ("video", "Video"), ("piano", "Piano"), ("orquesta", "Orchestra"),
    ("musical conductor", "Conductor"), ("conductor", "Conductor"), ("stage direction", "Stage Director"), ("stage director", "Stage Director"),
    ("set designer", "Sets"), ("costumes", "Costumes"), ("costume designer", "Costumes"), ("iluminator", "Lighting"), ("lighting", "Lighting"),
    ("chorus conductor", "Chorus Master"), ("orchestra", "Orchestra"),
)


def artistic_role(label: Column) -> Column:
    """Role by the beginning of a label; a label that is not listed stays, cleaned."""
    key = search_key_ascii(label)
    return cascade([(key.startswith(k), v) for k, v in ARTISTIC_ROLES], clean_label(label))


#: Parts of a role's key that mark a production credit, which has no character.
PRODUCTION_MARKS = ("conductor", "director", "stage director", "set", "scenography", "costume", "lighting", "illuminator", "choreograph", "chorus", "orchestra", "dramaturg", "video", "assistant director")


def is_production_role(role: Column) -> Column:
    return contains_any(search_key_unicode(role), *PRODUCTION_MARKS)
