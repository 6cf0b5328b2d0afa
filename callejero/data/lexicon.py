"""Rule data of the normalizer, read from ``lexicon.json`` or another file of its form."""

from __future__ import annotations

import json
from dataclasses import dataclass
from importlib import resources

#: Fixed values that no file changes: they are part of the rules.
CONNECTORS = "DE DEL LA LAS LOS EL Y"
GROUPING = "ETAPA SECTOR ZONA GRUPO"
UNITS_THAT_MAY_BE_WORDS = "TORRE CASA TDA LOCAL SOTANO STAND"
ORDINAL_ENDINGS = "RA ERA ER DA DO TA TO MA VA NA AVO"


@dataclass(frozen=True)
class Lexicon:
    """Canonical words and their variants; all in capitals without accents."""

    version: str
    street_types: dict[str, list[str]]
    unit_markers: dict[str, list[str]]
    urb_markers: dict[str, list[str]]
    phrases: dict[str, str]
    titles: dict[str, str]
    reference_markers: list[str]
    ordinal_words: dict[str, str]
    noise_prefixes: list[str]
    #: Markers that may open the name of an area on a map, and what each stands for.
    area_markers: dict[str, str]
    #: Words that change how an address is read if an area's name holds them (beside reference markers and street types).
    words_not_in_area_names: list[str]


def parse(text: str) -> Lexicon:
    """A lexicon from JSON; parts that are left out are empty, unknown ones an error."""
    raw = json.loads(text)
    known = Lexicon.__dataclass_fields__
    if wrong := set(raw) - set(known):
        raise ValueError(f"unknown parts of a lexicon: {sorted(wrong)}")
    empty = {name: {} if "dict" in f.type else [] if "list" in f.type else "" for name, f in known.items()}
    return Lexicon(**empty | raw)


def load(path: str | None = None) -> Lexicon:
    """The lexicon of a file, or the package's own."""
    if path is None:
        return parse(resources.files(__package__).joinpath("lexicon.json").read_text(encoding="utf-8"))
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


DEFAULT = load()


def zones(text: str) -> frozenset[str]:
    """The zones whose status is "active" in JSON {"zones": {name: status}}."""
    return frozenset(zone for zone, status in json.loads(text)["zones"].items() if status == "active")


def load_zones(path: str) -> frozenset[str]:
    with open(path, encoding="utf-8") as f:
        return zones(f.read())
