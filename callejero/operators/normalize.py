"""The address normalizer: one Arrow-batched pass over a deterministic reading of each text.

Some twenty-five rules read each other's state from left to right, so a text is read by plain
Python; requests are read once per distinct text of a batch. Absent parts are empty texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..data import lexicon as L
from ..functions.text import ACCENTED, MOJIBAKE, PHONETIC, PLAIN
from .catalog import Catalog, Place

FIELDS = ("address", "district", "province", "department", "ubigeo", "number", "reference")
PARTS = ("street_type", "street_name", "number", "interior", "block", "lot", "urbanization", "reference")
SCHEMA = ", ".join(f"{c} string" for c in (*PARTS, "loc_department", "loc_province", "loc_district", "loc_ubigeo", "zone")) + ", in_scope boolean, loc_source string, normalized string, match_key string, phonetic_key string, flags array<string>, version string"

_TABLE = str.maketrans(ACCENTED, PLAIN)


def fold(s: str) -> str:
    for wrong, right in MOJIBAKE:
        s = s.replace(wrong, right)
    up = "".join(u if len(u := ch.upper()) == 1 else ch for ch in s).translate(_TABLE)
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", up)


def key(s: str) -> str:
    return " ".join(re.sub(r"[^A-Z0-9\s]", " ", fold(s).replace("Ñ", "N"), flags=re.A).split())


def phonetic(s: str) -> str:
    s = key(s)
    for a, b in PHONETIC:
        s = s.replace(a, b)
    return " ".join(s.split())


def plain(word: str) -> str:
    return word.replace("Ñ", "N")


def inverted(groups: dict[str, list[str]]) -> dict[str, str]:
    return {key(variant): canon for canon, variants in groups.items() for variant in (canon, *variants)}


CONNECTORS, GROUPING, WORDY = set(L.CONNECTORS.split()), set(L.GROUPING.split()), set(L.UNITS_THAT_MAY_BE_WORDS.split())
SEP = "QSEPQ"


def rx(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.A)


#: How a text is rewritten before it is cut into words, in this order.
REWRITES = [(rx(p), to) for p, to in (
    (r"\bS\s*/\s*N\b", " SINNUMERO "), (r"#|\bN[°º]\.?|\bNRO\b\.?|\bNUM(?:ERO)?\b\.?", " NRO "), (r"\bA\.?\s?A\.?\s?H\.?\s?H\b\.?", " AAHH "),
    (r"\bA\.\s?H\b\.?", " AAHH "), (r"\bASENT\.?\s?H(?:UM)?\b\.?", " AAHH "), (r"\bA\.\s?P\.\s?V\b\.?", " APV "), (r"\bP\.\s?J\b\.?", " PJ "),
)]
HYPHENS = [(rx(p), to) for p, to in ((r"(\d)-([A-Z])\b", r"\1\2"), (r"\b([A-Z]{1,2})-(\d+)\b", r"\1\2"), (r"(\d)-+([A-Z]{2})", r"\1 - \2"), (r"([A-Z])-([A-Z])", r"\1 - \2"), (r"[,;]|\s-+\s?|-+\s", f" {SEP} "))]
PUNCT = rx(r"[^A-Z0-9Ñ\s]")
MZ_LT, MZ, GLUED = rx(r"MZ([A-Z]?\d{0,3}[A-Z]?)LT(\d+[A-Z]?)"), rx(r"MZ([A-Z]\d?|\d+)"), rx(r"(LT|LOTE|INT|DPTO|DPT|DP|OF|PISO|CALLE|CL|CLL|AV|JR|PSJE|PJE)(\d+[A-Z]?)")
VALUE, CODE, NUMBER = rx(r"[A-Z]{1,2}\d+[A-Z]?|\d+[A-Z]{0,2}|[A-Z]"), rx(r"[A-Z]{1,2}\d+[A-Z]?"), rx(r"\d+[A-Z]?")
ORDINAL, POSTAL = rx(rf"(\d+)({L.ORDINAL_ENDINGS.replace(' ', '|')})"), rx(r"(0[1-9]|1\d|2[0-5])\d{3}")


class Rules:
    """A lexicon made ready: words to their canonical form, and the patterns that depend on it."""

    def __init__(self, lexicon: L.Lexicon) -> None:
        self.street, self.unit, self.urb = inverted(lexicon.street_types), inverted(lexicon.unit_markers), inverted(lexicon.urb_markers)
        self.titles = {key(k): v for k, v in lexicon.titles.items()}
        self.markers = set(map(key, lexicon.reference_markers))
        self.ordinals = {key(k): v for k, v in lexicon.ordinal_words.items()}
        self.phrases = [(rx(rf"\b{re.escape(key(k))}\b"), v) for k, v in sorted(lexicon.phrases.items(), key=lambda x: -len(x[0]))]
        self.noise = rx(r"^\s*(?:" + "|".join(re.escape(fold(x)) for x in lexicon.noise_prefixes) + r")\b[\s:-]*") if lexicon.noise_prefixes else None
        floor = [r"(\d{1,2})\s?(?:ER|RO|DO|DA|TO|TA|VO|NO|MO|RA)?\.?", f"({'|'.join(sorted(self.ordinals))})"][: 1 + bool(self.ordinals)]
        self.floors = [rx(rf"\b{f}\s+(?:PISO|NIVEL)\b(?!\s+\d)") for f in floor]
        self.version = f"callejero/1 lexicon/{lexicon.version}"


def is_number(w: str) -> bool:
    return NUMBER.fullmatch(w) is not None


def has_digit(words: list[str]) -> bool:
    return any(c in "0123456789" for w in words for c in w)


def letter(w: str) -> bool:
    return len(w) == 1 and "A" <= w <= "Z"


class Flags(dict):
    """Flags in the order they were raised."""

    def raise_(self, *names: str) -> None:
        for n in names:
            self.setdefault(n)

    def drop(self, name: str) -> None:
        self.pop(name, None)


@dataclass
class Words:
    """The words of a text; ``sep[i]`` tells whether a comma or dash stands before word i (the last entry: at the end)."""

    w: list[str] = field(default_factory=list)
    sep: list[bool] = field(default_factory=list)

    def cut(self, a: int, b: int | None = None) -> Words:
        return Words(self.w[a:b], self.sep[a:])


@dataclass
class Suffix:
    place: Place | None = None
    province: str = ""
    department: str = ""
    weak: bool = False
    ok: bool = False
    flags: tuple[str, ...] = ()


class Normalizer:
    def __init__(self, catalog: Catalog, active_zones: frozenset[str] = frozenset(), default: tuple[str, str] = ("", ""), lexicon: L.Lexicon = L.DEFAULT) -> None:
        self.cat, self.active, self.default, self.rules = catalog, active_zones, default, Rules(lexicon)
        self.splits = (self.no_number, self.glued(MZ_LT, "MZ", "LT"), self.bare_block, self.glued(MZ, "MZ"), self.glued(GLUED, "", ""))
        #: What a text may end in: flag, words to drop (an old postal zone takes its city's name along), and whether it does.
        self.tails = (
            ("COUNTRY_REMOVED", 1, lambda w, sep: w[-1] == "PERU" and (sep[len(w) - 1] or is_number(w[-2]) or self.cat.known(key(w[-2])))),
            ("POSTAL_CODE_IN_TEXT", 2, lambda w, sep: len(w) > 2 and sep[len(w) - 2] and w[-2] in ("LIMA", "CALLAO") and re.fullmatch(r"[0-9]{1,2}", w[-1])),
            ("UBIGEO_IN_TEXT", 1, lambda w, sep: re.fullmatch(r"[0-9]{6}", w[-1]) and w[-1] in self.cat.by_code),
            ("POSTAL_CODE_IN_TEXT", 1, lambda w, sep: POSTAL.fullmatch(w[-1]) and any(map(is_number, w[:-1]))),
        )

    # -- words ------------------------------------------------------------
    def words(self, raw: str, flags: Flags) -> tuple[Words, list[str]]:
        s = fold(raw)
        if self.rules.noise and self.rules.noise.match(s):
            s = self.rules.noise.sub(" ", s)
            flags.raise_("NOISE_PREFIX_REMOVED")
        refs = [r for m in re.findall(r"\(([^)]*)\)", s) if (r := " ".join(PUNCT.sub(" ", m).split()))]
        s = re.sub(r"\([^)]*\)", " ", s)
        for pattern, to in REWRITES:
            s = pattern.sub(to, s)
        for pattern in self.rules.floors:
            s = pattern.sub(lambda m: f" PISO {self.rules.ordinals.get(m[1], m[1])} ", s)
        for pattern, to in HYPHENS:
            s = pattern.sub(to, s)
        s = " ".join(PUNCT.sub(" ", s).split())
        for pattern, to in self.rules.phrases:
            s = pattern.sub(to, s)
        out, pending = Words(), False
        fields = s.split()
        for word, after in zip(fields, [*fields[1:], None]):
            if word == SEP:
                pending = True
            elif word != "NRO":
                pieces = next((pieces for split in self.splits if (pieces := split(word, after, out.w))), [word])
                out.w += pieces
                out.sep += [pending, *[False] * (len(pieces) - 1)]
                pending = False
        out.sep.append(pending)
        return out, refs

    # A word as it stands before another (None: at the end) and behind others is several words, or means another one.
    def opens_unit(self, word: str | None) -> bool:
        return word is not None and (plain(word) in self.rules.unit or plain(word) in self.rules.urb)

    def no_number(self, word: str, after: str | None, before: list[str]) -> list[str] | None:
        return ["SINNUMERO"] if word == "SN" and before and (after in (None, SEP) or self.opens_unit(after)) else None

    def bare_block(self, word: str, after: str | None, before: list[str]) -> list[str] | None:
        short = after not in (None, SEP) and len(after.encode()) <= 3 and not self.opens_unit(after) and not GLUED.fullmatch(after)
        return ["MZ"] if word == "MZA" and short else None

    @staticmethod
    def glued(pattern: re.Pattern, *marks: str):
        """A split by a pattern's groups, each behind its mark (the empty mark: as it is)."""
        return lambda word, after, before: [x for mark, g in zip(marks, m.groups()) for x in ([mark, g] if mark else [g])] if (m := pattern.fullmatch(word)) else None


    def unrepeated(self, t: Words, flags: Flags) -> Words:
        n = len(t.w)
        for k in range(max(3, (n + 1) // 2), n - 2):
            tail, head = t.w[k:], t.w[: n - k]
            if tail[:-1] == head[:-1] and head[-1].startswith(tail[-1]):
                flags.raise_("DUPLICATED_TEXT")
                return Words(t.w[:k], t.sep[:k] + [t.sep[n]])
        return t

    def applies(self, w: list[str], i: int) -> bool:
        """Whether a unit marker is one here: some are also ordinary words."""
        if self.rules.unit[plain(w[i])] not in WORDY:
            return True
        return not (i and w[i - 1] in CONNECTORS) and i + 1 < len(w) and len(w[i + 1].encode()) <= 4 and VALUE.fullmatch(w[i + 1]) is not None

    def goes_on(self, w: list[str], sep: list[bool]) -> bool:
        """Whether what follows ``w`` would continue an urbanization's name."""
        for i in range(len(w) - 1, -1, -1):
            p = plain(w[i])
            if p in self.rules.urb:
                return not (i == len(w) - 2 and len(w[i + 1].encode()) <= 2 and self.rules.urb[p] in GROUPING)
            if p in self.rules.street or p in self.rules.unit or is_number(w[i]) or sep[i]:
                return False
        return False

    def without_reference(self, t: Words) -> tuple[Words, list[str]]:
        w = t.w
        for i in range(2, len(w)):
            house = self.rules.unit.get(plain(w[i])) == "CASA" and not self.applies(w, i) and (i == len(w) - 1 or t.sep[i] or not self.goes_on(w[:i], t.sep))
            if house or plain(w[i]) in self.rules.markers:
                at = i - 1 if w[i - 1] in ("AL", "A", "POR") else i
                return t.cut(0, at), w[at:]
        return t, []

    def without_tail(self, t: Words, flags: Flags) -> Words:
        n = len(t.w)
        while n > 1 and (hit := next(((flag, words) for flag, words, ends in self.tails if ends(t.w[:n], t.sep)), None)):
            flags.raise_(hit[0])
            n -= hit[1]
        return Words(t.w[:n], t.sep)

    def without_prefix(self, t: Words, district: str, refs: list[str], flags: Flags) -> Words:
        w, dk = t.w, key(district)
        if dk:
            for k in range(1, min(len(w) - 1, self.cat.max_words) + 1):
                if k < len(w) and key(" ".join(w[:k])) == dk and (plain(w[k]) in self.rules.urb or plain(w[k]) in self.rules.unit):
                    flags.raise_("DISTRICT_PREFIX_REMOVED")
                    return t.cut(k)
        s = next((s for s in range(1, min(4, len(w) - 2) + 1) if t.sep[s]), None)
        if s and plain(w[s]) in self.rules.street and w[s] != "C" and not has_digit(w[:s]) and plain(w[0]) not in self.rules.urb and plain(w[0]) not in self.rules.unit:
            refs[:0] = w[:s]
            flags.raise_("ESTABLISHMENT_PREFIX")
            return t.cut(s)
        return t

    # -- places -----------------------------------------------------------
    def suffix_names(self, t: Words) -> tuple[list[str], int]:
        """Names of places at the end, outermost last, and where they begin."""
        names: list[str] = []
        end = len(t.w)
        while len(names) < 3:
            for k in range(min(self.cat.max_words, end), 0, -1):
                at, name = end - k, key(" ".join(t.w[end - k : end]))
                if not self.cat.known(name) or (names and not self.cat.nests(name, names[0])):
                    continue
                if at and not t.sep[at] and (t.w[at - 1] in CONNECTORS or (plain(t.w[at - 1]) in self.rules.street and t.w[at - 1] != "C")):
                    continue
                names.insert(0, name)
                end = at
                break
            else:
                break
            if name not in self.cat.provinces and name not in self.cat.departments:
                break
        return names, end

    def only_active(self, hits):
        found = [h for h in hits if h[0].zone in self.active]
        return found[0] if len(found) == 1 else None

    def area(self, name: str) -> Suffix | None:
        province, department = self.cat.provinces.get(name), self.cat.departments.get(name)
        p = province or department
        if p is None:
            return None
        return Suffix(province=p.province if province else "", department=p.department, ok=True, flags=(f"AMBIGUOUS_{name.replace(' ', '_')}",) if province and department else ())

    def read_names(self, names: list[str], province: str, department: str) -> Suffix:
        hit = lambda h, *flags: Suffix(place=h[0], weak=h[1], ok=True, flags=flags)
        if not names:
            return Suffix()
        hits = self.cat.districts(names[0])
        if len(names) == 1:
            name = names[0]
            if (province or department) and name not in (province, department):
                near = [h for h in hits if province in ("", h[0].province_key) and department in ("", h[0].department_key)]
                if len(near) == 1:
                    return hit(near[0])
            is_area = name in self.cat.provinces or name in self.cat.departments
            whole = self.cat.provinces.get(name) or self.cat.departments.get(name)
            if (len(hits) > 1 or is_area) and not (whole and whole.zone in self.active):
                if h := self.only_active(hits):
                    return hit(h, "DISTRICT_BY_ACTIVE_ZONE")
                if any(name not in (h[0].province_key, h[0].department_key) for h in hits):
                    return Suffix(flags=("AMBIGUOUS_DISTRICT",))
            if is_area:
                return self.area(name)
            if len(hits) == 1:
                return hit(hits[0])
            return Suffix(flags=("AMBIGUOUS_DISTRICT",) if hits else ("LOCATION_INCONSISTENT",))
        if len(names) == 2 and names[0] == names[1] and (a := self.area(names[0])):
            return a
        for h in hits:
            above = (h[0].province_key, h[0].department_key)
            if (len(names) == 3 and above == (names[1], names[2])) or (len(names) == 2 and names[1] in above):
                return hit(h)
        return Suffix(flags=("LOCATION_INCONSISTENT",))

    def of_fields(self, r: dict, flags: Flags) -> tuple[Place | None, str, str, str]:
        """Place, province, department, source by the structured fields."""
        dk, pk, ek = key(r["district"]), key(r["province"]), key(r["department"])
        inside = lambda hits: [h for h in hits if pk in ("", h[0].province_key) and ek in ("", h[0].department_key)]
        none = (None, "", "", "NONE")
        at = lambda h: (h[0], h[0].province, h[0].department, "FIELD")
        if dk:
            hits = self.cat.districts(dk)
            near = inside(hits)
            chosen = near[0] if len(near) == 1 else self.only_active(near) if near else None
            if near:
                if chosen is None:
                    flags.raise_("AMBIGUOUS_DISTRICT")
                    return none
                if len(near) > 1:
                    flags.raise_("DISTRICT_BY_ACTIVE_ZONE")
                if chosen[1]:
                    flags.raise_("WEAK_DISTRICT_ALIAS")
                return at(chosen)
            if hits:
                flags.raise_("LOCATION_INCONSISTENT")
                return at(hits[0]) if len(hits) == 1 else none
            part = inside(self.cat.partial(dk))
            if len(part) == 1:
                flags.raise_("DISTRICT_FIELD_PARTIAL")
                return at(part[0])
            flags.raise_("UNKNOWN_DISTRICT")
        if pk:
            if p := self.cat.provinces.get(pk):
                return None, p.province, p.department, "FIELD"
            flags.raise_("UNKNOWN_PROVINCE")
        if ek:
            if p := self.cat.departments.get(ek):
                return None, "", p.department, "FIELD"
            flags.raise_("UNKNOWN_DEPARTMENT")
        return none

    def located(self, r: dict, s: Suffix, flags: Flags) -> dict:
        place, province, department, source = None, "", "", "NONE"
        if code := r["ubigeo"].strip():
            if place := self.cat.by_code.get(code):
                province, department, source = place.province, place.department, "UBIGEO"
                named = [h[0] for h in self.cat.districts(key(r["district"]))]
                if named and place not in named:
                    flags.raise_("DISTRICT_CONFLICT")
            else:
                flags.raise_("INVALID_UBIGEO")
        if source == "NONE":
            place, province, department, source = self.of_fields(r, flags)
        flags.raise_(*s.flags)
        if s.ok:
            p = s.place
            generic = p and place and source == "FIELD" and key(place.district) == key(province) == p.province_key and p.code != place.code
            if source == "NONE" and not p:
                province, department, source = s.province, s.department, "TEXT"
            elif p and (source == "NONE" or (not place and (not province or key(province) == p.province_key)) or generic):
                if generic:
                    flags.raise_("GENERIC_DISTRICT_FIELD")
                elif s.weak:
                    flags.raise_("WEAK_DISTRICT_ALIAS")
                place, province, department, source = p, p.province, p.department, "TEXT"
            elif p and place and p.code != place.code:
                flags.raise_("DISTRICT_CONFLICT")
        if not province and not department and self.default[0]:
            (province, department), source = self.default, "DEFAULT"
            flags.raise_("AREA_FROM_DEFAULT")
        whole = self.cat.provinces.get(key(province))
        zone = whole.zone if whole else ""
        if source == "NONE":
            flags.raise_("LOCATION_UNKNOWN")
        return {"loc_department": department, "loc_province": province, "loc_district": place.district if place else "", "loc_ubigeo": place.code if place else "", "zone": zone, "in_scope": bool(zone) and zone in self.active, "loc_source": source}

    # -- roles ------------------------------------------------------------
    def roles(self, w: list[str], ubigeo: str, flags: Flags) -> dict:
        c = dict.fromkeys(PARTS, "")
        bag: dict[str, list[str]] = {k: [] for k in ("street", "urb", "trailing", "units", "loose", "stage")}
        i = 0
        if w and (canon := self.rules.street.get(plain(w[0]))):
            if w[0] == "C":
                flags.raise_("GUARDED_C_AS_CALLE")
            if w[0] != canon:
                flags.raise_("ABBREVIATION_EXPANDED")
            c["street_type"], i = canon, 1
        elif w:
            flags.raise_("NO_STREET_TYPE")
        mode, seen_unit, seen_plot = "", False, False

        def settle(before_marker: bool) -> None:
            """Say what unmarked text after a block or lot was."""
            loose = bag["loose"]
            if not loose:
                return
            if before_marker and "ETAPA" in loose:
                to = "stage"
            elif not bag["street"] and not c["street_type"] and len(loose) > 1 and is_number(loose[-1]) and len(loose[-1]) >= 2:
                to = "street"
                flags.raise_("STREET_AFTER_BLOCK")
            elif before_marker or bag["urb"]:
                to = "trailing"
            else:
                to = "urb"
                flags.raise_("URBANIZATION_WITHOUT_MARKER")
            bag[to] += loose
            bag["loose"] = []

        def grouped(at: int) -> str:
            ordinal = self.rules.ordinals.get(plain(w[at]))
            if ordinal and at + 1 < len(w) and w[at + 1] in GROUPING:
                return ordinal
            m = ORDINAL.fullmatch(w[at])
            return m[1] if m else w[at]

        while i < len(w):
            word, p = w[i], plain(w[i])
            named = mode == "urb" and len(bag["urb"]) > 1
            if (named or seen_unit) and not c["street_type"] and not bag["street"] and i + 1 < len(w) and word != "C" and p in self.rules.street:
                settle(False)
                c["street_type"], mode = self.rules.street[p], "street"
                flags.drop("NO_STREET_TYPE")
                if word != self.rules.street[p]:
                    flags.raise_("ABBREVIATION_EXPANDED")
            elif p in self.rules.unit and self.applies(w, i):
                settle(False)
                i = self._unit(w, i, c, bag, flags)
                seen_unit, seen_plot = True, seen_plot or self.rules.unit[p] in ("MZ", "LT")
            elif p in self.rules.urb:
                settle(True)
                if word != self.rules.urb[p]:
                    flags.raise_("ABBREVIATION_EXPANDED")
                bag["urb"].append(self.rules.urb[p])
                mode = "urb"
            elif mode == "street":
                bag["street"].append(word)
            elif named and not seen_unit and len(word) >= 3 and is_number(word) and (c["street_type"] or bag["street"]) and not has_digit(bag["street"]):
                bag["street"].append(word)
                flags.raise_("NUMBER_AFTER_URBANIZATION")
            elif named and i == len(w) - 1 and CODE.fullmatch(word) and has_digit(bag["street"]):
                bag["units"].append(word)
                flags.raise_("INTERIOR_CODE_AFTER_URBANIZATION")
            elif mode == "urb":
                bag["urb"].append(grouped(i))
            elif bag["loose"] or (seen_plot and not bag["urb"] and not is_number(word)):
                bag["loose"].append(grouped(i))
            else:
                bag["trailing" if seen_unit else "street"].append(word)
            i += 1
        settle(False)
        self._street(bag["street"], c, flags)
        if bag["trailing"]:
            flags.raise_("TRAILING_TEXT_MOVED_TO_REFERENCE")
            c["reference"] = " ".join([c["reference"], *bag["trailing"]]).strip()
        valued = {u.split()[0] for u in bag["units"] if " " in u}
        units = [u for u in dict.fromkeys(bag["units"]) if " " in u or u not in valued]
        c["interior"] = " ".join([c["interior"], *units]).strip()
        urb = self._own_district_cut(bag["urb"], ubigeo, flags) + bag["stage"]
        c["urbanization"] = " ".join(urb)
        if len(urb) == 1 and plain(urb[0]) in self.rules.urb:
            flags.raise_("EMPTY_URBANIZATION_NAME")
        return c

    def _unit(self, w: list[str], i: int, c: dict, bag: dict, flags: Flags) -> int:
        """Read a unit's value; returns the index of the last word used."""
        canon, marker = self.rules.unit[plain(w[i])], lambda j: plain(w[j]) in self.rules.unit or plain(w[j]) in self.rules.urb
        value = ""
        if i + 2 < len(w) and w[i + 1] in ("DE", "DEL") and VALUE.fullmatch(w[i + 2]):
            i += 1
        if i + 1 < len(w) and not marker(i + 1):
            i += 1
            value = w[i]
            if canon == "LT" and i + 1 < len(w) and letter(w[i + 1]) and (i + 2 == len(w) or marker(i + 2)):
                i += 1
                value += w[i]
            if i + 1 < len(w) and w[i + 1] == value:
                i += 1
                flags.raise_("REPEATED_VALUE")
        else:
            flags.raise_("MISSING_UNIT_VALUE")
        if canon in ("MZ", "LT"):
            c["block" if canon == "MZ" else "lot"] = value
        else:
            bag["units"].append(f"{canon} {value}".strip())
        return i

    def _street(self, street: list[str], c: dict, flags: Flags) -> None:
        name, rest = street, []
        if "SINNUMERO" in street:
            at = street.index("SINNUMERO")
            c["number"], name, rest = "S/N", street[:at], street[at + 1 :]
            flags.raise_("NO_NUMBER")
        else:
            last = next((i for i in range(len(street) - 1, -1, -1) if is_number(street[i]) and street[i + 1 : i + 2] != ["DE"]), -1)
            clean = last > 1 and not has_digit(street[: last - 1])
            if clean and street[last - 1] == street[last]:
                c["number"], name, rest = street[last], street[: last - 1], street[last + 1 :]
                flags.raise_("REPEATED_NUMBER")
            elif clean and is_number(street[last - 1]):
                c["number"], c["interior"], name, rest = street[last - 1], street[last], street[: last - 1], street[last + 1 :]
                flags.raise_("INTERIOR_FROM_BARE_NUMBER")
            elif last > 0:
                c["number"], name, rest = street[last], street[:last], street[last + 1 :]
                if len(rest) == 1 and letter(rest[0]):
                    c["number"], rest = c["number"] + rest[0], []
                elif len(rest) == 1 and CODE.fullmatch(rest[0]):
                    c["interior"], rest = rest[0], []
                    flags.raise_("INTERIOR_FROM_BARE_NUMBER")
        if rest:
            flags.raise_("TRAILING_TEXT_MOVED_TO_REFERENCE")
            c["reference"] = " ".join(rest)
        full = [self.rules.titles.get(plain(x), x) if i < len(name) - 1 else x for i, x in enumerate(name)]
        if full != name:
            flags.raise_("ABBREVIATION_EXPANDED")
        c["street_name"] = " ".join(full)
        if c["street_type"] and not full:
            flags.raise_("NO_STREET_NAME")

    def _own_district_cut(self, urb: list[str], ubigeo: str, flags: Flags) -> list[str]:
        place = self.cat.by_code.get(ubigeo)
        if place and len(urb) >= 3:
            keys = [key(x) for x in urb]
            names = [n.split() for n in (place.district_key, *map(key, place.aliases))]
            for j in range(2, len(keys)):
                if keys[j - 1] not in CONNECTORS and any(keys[j : j + len(n)] == n for n in names):
                    flags.raise_("DISTRICT_REMOVED_FROM_URBANIZATION")
                    return urb[:j]
        return urb

    # -- whole ------------------------------------------------------------
    def __call__(self, r: dict) -> dict:
        flags = Flags()
        t, refs = self.words(r["address"], flags)
        t = self.unrepeated(t, flags)
        if not t.w:
            flags.raise_("EMPTY_ADDRESS")
        t, tail = self.without_reference(t)
        refs += tail
        t = self.without_tail(t, flags)
        t = self.without_prefix(t, r["district"], refs, flags)
        if len(t.w) > 1 and t.w[-1] != "C" and self.rules.street.get(plain(t.w[-1])) in ("CALLE", "AVENIDA", "JIRON", "PASAJE"):
            refs.insert(0, t.w[-1])
            t = Words(t.w[:-1], t.sep)
        names, at = self.suffix_names(t)
        s = self.read_names(names, key(r["province"]), key(r["department"]))
        words = t.w
        if names:
            rest = words[:at]
            structural = lambda x: any(plain(x) in d for d in (self.rules.street, self.rules.urb, self.rules.unit))
            if not rest or (len(rest) == 1 and structural(rest[0])):
                flags.raise_("LOCATION_SUFFIX_SKIPPED")
                s = Suffix()
            elif (r["district"].strip() or r["ubigeo"].strip()) and not t.sep[at] and self.goes_on(rest, t.sep):
                flags.raise_("DISTRICT_NAME_IN_TEXT")
                s = Suffix()
            elif not s.ok:
                flags.raise_("LOCATION_SUFFIX_UNRESOLVED", *s.flags)
                s = Suffix()
            else:
                words = rest
        loc = self.located(r, s, flags)
        c = self.roles(words, loc["loc_ubigeo"], flags)
        self._number_field(r["number"], c, flags)
        if extra := " ".join(PUNCT.sub(" ", fold(r["reference"])).split()):
            refs.append(extra)
        if loc["loc_source"] == "NONE" and self.cat.names_district(key(c["urbanization"])):
            flags.raise_("DISTRICT_NAME_IN_URBANIZATION")
        c["reference"] = " ".join([c["reference"], *refs]).strip() if refs else c["reference"]
        if not (c["number"] or c["block"] or c["lot"]):
            flags.raise_("NO_NUMBER")
        plot = [f"MZ {c['block']}" if c["block"] else "", f"LT {c['lot']}" if c["lot"] else ""]
        normalized = " ".join(x for x in (c["street_type"], c["street_name"], c["number"], *plot, c["interior"], c["urbanization"]) if x)
        keyed = lambda f: "|".join(x for x in (c["street_type"], f(c["street_name"]), c["number"], *[p.replace(" ", ":", 1) for p in plot], f"URB:{f(c['urbanization'])}" if c["urbanization"] else "") if x)
        return {**c, **loc, "normalized": normalized, "match_key": keyed(key), "phonetic_key": keyed(phonetic), "flags": list(flags), "version": self.rules.version}

    def _number_field(self, text: str, c: dict, flags: Flags) -> None:
        n = "".join(PUNCT.sub(" ", fold(text)).split())
        if not n:
            return
        if n in ("SN", "SINNUMERO", "0"):
            n = "S/N"
        elif not is_number(n):
            flags.raise_("NUMBER_FIELD_INVALID")
            return
        if not c["number"]:
            c["number"] = n
            flags.raise_("NUMBER_FROM_FIELD")
            if n != "S/N":
                flags.drop("NO_NUMBER")
        elif c["number"] != n:
            flags.raise_("NUMBER_FIELD_CONFLICT")


def normalize(requests: DataFrame, entries: list[dict], active_zones: frozenset[str] = frozenset(), default: tuple[str, str] = ("", ""), lexicon: L.Lexicon = L.DEFAULT) -> DataFrame:
    """The input's columns and those of SCHEMA; an input column of a name in SCHEMA (``number``, ``reference``) comes back as ``asked_<name>``.

    Missing request columns and nulls count as empty; the catalog (one row per district) and the
    lexicon go along with the function.
    """
    read_as = [c.rsplit(" ", 1) for c in SCHEMA.split(", ")]
    names = [n for n, _ in read_as]
    types = [pa.bool_() if t == "boolean" else pa.list_(pa.string()) if t.startswith("array") else pa.string() for _, t in read_as]
    kept = [(f.name, f"asked_{f.name}" if f.name in names else f.name, f.dataType.simpleString()) for f in requests.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Normalizer(Catalog(entries), active_zones, default, lexicon)
        for batch in batches:
            read = cache(lambda *values: reader(dict(zip(FIELDS, values))))
            asked = [batch.column(f).cast(pa.string()).fill_null("").to_pylist() if f in batch.schema.names else [""] * batch.num_rows for f in FIELDS]
            rows = [read(*values) for values in zip(*asked)]
            read_columns = [pa.array([r[n] for r in rows], t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *read_columns], [*(out for _, out, _ in kept), *names])

    return requests.mapInArrow(run, ", ".join([*(f"`{out}` {kind}" for _, out, kind in kept), SCHEMA]))
