"""Label normalisation and hierarchy lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom import taxonomy as T


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """A constant map's value, or null."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, key)


def lowered(label: Column) -> Column:
    return F.lower(F.trim(label))


def normalize(label: Column) -> Column:
    """Lower case, single spaces; ``unknown`` for nothing."""
    text = F.trim(F.regexp_replace(F.lower(label), r"\s+", " "))
    return F.coalesce(F.when(text != "", text), F.lit("unknown"))


def clean_display(label: Column, fallback: str = "unknown") -> Column:
    """Trimmed; the fallback for nothing and for leaked word pieces."""
    text = F.trim(label)
    return F.when(F.coalesce(text, F.lit("")).eqNullSafe("") | text.startswith("##") | (text == "#"), F.lit(fallback)).otherwise(text)


def review_coarse(label: Column) -> Column:
    """Coarse group of a label in the review hierarchy; ``unknown`` outside."""
    return F.coalesce(looked_up(normalize(label), T.inverted(T.REVIEW_HIERARCHY)), F.lit("unknown"))


def display(label: Column) -> Column:
    """``coarse:fine``."""
    return F.concat_ws(":", review_coarse(label), normalize(label))


def parse_display(label: Column) -> Column:
    """struct(coarse, fine) of ``coarse:fine`` or of a plain label."""
    text = F.trim(F.coalesce(label, F.lit("")))
    at = F.instr(text, ":")
    fine = normalize(F.when(at > 0, F.substr(text, at + 1)).otherwise(text))
    named = normalize(F.substr(text, F.lit(1), at - 1))
    coarse = F.when((at > 0) & (named != "unknown"), named).otherwise(review_coarse(fine))
    return F.struct(coarse.alias("coarse"), fine.alias("fine"))


def shown(label: Column, mode: str = "coarse_fine") -> Column:
    """A label in mode ``fine``, ``coarse`` or ``coarse_fine``."""
    parts = parse_display(label)
    return parts[mode] if mode in ("fine", "coarse") else F.concat_ws(":", parts["coarse"], parts["fine"])


def same_coarse(a: Column, b: Column) -> Column:
    return review_coarse(a) == review_coarse(b)


def conflict_level(predicted: Column, target: Column) -> Column:
    return F.when(normalize(predicted) == normalize(target), "match").when(same_coarse(predicted, target), "fine_conflict").otherwise("coarse_conflict")


def fine(raw: Column) -> Column:
    """Synonyms folded; other labels trimmed, in their own case."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.coalesce(looked_up(F.lower(text), T.FINE_SYNONYMS), F.when(text != "", text), F.lit("unknown"))


def tracking_coarse(label: Column) -> Column:
    """Tracking group of a label; the trimmed label itself outside."""
    return F.coalesce(looked_up(lowered(label), T.inverted(T.TRACKING_GROUPS)), F.trim(label))


def inference_coarse(label: Column) -> Column:
    return F.coalesce(looked_up(lowered(label), T.inverted(T.INFERENCE_TAXONOMY)), label)


def cookware_kind(label: Column) -> Column:
    """``body``, ``lid`` or null."""
    return F.when(lowered(label).isin(*T.COOKWARE_BODIES), "body").when(lowered(label).isin(*T.COOKWARE_LIDS), "lid")


def is_lid_like(label: Column) -> Column:
    return lowered(label).isin(*T.COOKWARE_LIDS)


def is_plate_proxy(label: Column) -> Column:
    return lowered(label).isin(*T.PLATE_PROXIES)


def is_scene(label: Column) -> Column:
    return lowered(label).isin(*T.SCENE_SUPPORTS, *T.SCENE_BACKGROUNDS)


def is_movable(label: Column) -> Column:
    return lowered(label).isin(*{*T.MOVABLE, *T.COOKWARE_BODIES, *T.COOKWARE_LIDS, *T.MANIPULABLE})


def surface_kind(label: Column) -> Column:
    return F.when(lowered(label).isin(*T.SCENE_SUPPORTS), "support_surface").when(lowered(label).isin(*T.SCENE_BACKGROUNDS), "background_surface")


def canonical_scene(label: Column) -> Column:
    return F.coalesce(looked_up(lowered(label), T.SCENE_CANONICAL), lowered(label))


def same_family(a: Column, b: Column) -> Column:
    """Equal coarse labels, or both cookware of one kind."""
    return (lowered(a) == lowered(b)) | F.coalesce(cookware_kind(a) == cookware_kind(b), F.lit(False))


def slug(label: Column) -> Column:
    """Safe for a folder's name."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[^a-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")


def words_of(label: Column) -> Column:
    """Tokens apart by single spaces, hyphens as spaces, spaces at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.translate(label, "-", " ")), r"\s+", " ")), F.lit(" "))


def prompt_matches(prompt: Column, raw: Column) -> Column:
    """One is the other or a run of its tokens."""
    return F.contains(words_of(raw), words_of(prompt)) | F.contains(words_of(prompt), words_of(raw))


def distinct_folded(labels: Column) -> Column:
    """Distinct labels of an array in order, compared without case, blank ones dropped."""
    clean = F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)


def prompt_labels(prompt: Column) -> Column:
    """Comma-separated prompt -> labels, words expanded, distinct."""
    table = F.create_map(*[x for k, v in T.PROMPT_EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    parts = F.transform(F.split(prompt, ","), lambda x: F.trim(x))
    return distinct_folded(F.flatten(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, F.lower(p)), F.array(p)))))


def file_stem(path: Column) -> Column:
    """The file's name without folder and ending, and ten digits of the path's SHA-1."""
    name = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.concat(name, F.lit("_"), F.substring(F.sha1(path.cast("binary")), 1, 10))
