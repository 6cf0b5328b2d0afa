"""The catalog of districts: names, aliases, areas, and lookups as joins."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_PREFIX = 12


@dataclass(frozen=True)
class Place:
    code: str
    department: str
    province: str
    district: str
    zone: str = ""
    aliases: tuple[str, ...] = ()
    weak_aliases: tuple[str, ...] = ()
    district_key: str = ""
    province_key: str = ""
    department_key: str = ""


class Catalog:
    """Name indexes over catalog entries; the first entry of a province or department stands for it."""

    def __init__(self, entries: list[dict]) -> None:
        from .normalize import key

        self.by_code: dict[str, Place] = {}
        self.names: dict[str, list[tuple[Place, bool]]] = {}
        self.provinces: dict[str, Place] = {}
        self.departments: dict[str, Place] = {}
        for e in entries:
            code = e["code"]
            if len(code) != 6 or not (e["department"] and e["province"] and e["district"]) or code in self.by_code:
                raise ValueError(f"bad catalog entry {code!r}")
            p = Place(code, e["department"], e["province"], e["district"], e.get("zone") or "", tuple(e.get("aliases") or ()), tuple(e.get("weak_aliases") or ()), key(e["district"]), key(e["province"]), key(e["department"]))
            self.by_code[code] = p
            for name, weak in [(p.district, False), *((a, False) for a in p.aliases), *((a, True) for a in p.weak_aliases)]:
                hits = self.names.setdefault(key(name), [])
                if all(h[0] is not p for h in hits):
                    hits.append((p, weak))
            self.provinces.setdefault(p.province_key, p)
            self.departments.setdefault(p.department_key, p)
        every = [*self.names, *self.provinces, *self.departments]
        self.max_words = max((len(n.split()) for n in every), default=0)
        self.nested = {(p.province_key, p.department_key) for p in self.by_code.values()}

    def districts(self, name: str) -> list[tuple[Place, bool]]:
        return self.names.get(name, [])

    def known(self, name: str) -> bool:
        return name in self.names or name in self.provinces or name in self.departments

    def nests(self, inner: str, outer: str) -> bool:
        return inner == outer or any(outer in (h[0].province_key, h[0].department_key) for h in self.districts(inner)) or (inner in self.provinces and (inner, outer) in self.nested)

    def partial(self, name: str) -> list[tuple[Place, bool]]:
        """Districts of which a strong name and ``name`` are prefixes of each other, from MIN_PREFIX letters on; by code."""
        found = {}
        for known, hits in self.names.items():
            short = min(len(known), len(name))
            if short >= MIN_PREFIX and known[:short] == name[:short]:
                found |= {h[0].code: h for h in hits if not h[1]}
        return [found[c] for c in sorted(found)]

    def names_district(self, text: str) -> bool:
        w = text.split()
        return any(not weak for i in range(len(w)) for k in range(1, self.max_words + 1) if i + k <= len(w) for _, weak in self.districts(" ".join(w[i : i + k])))


def load(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["entries"]


def table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    rows = [(e["code"], e["department"], e["province"], e["district"], e.get("zone") or "", list(e.get("aliases") or []), list(e.get("weak_aliases") or [])) for e in entries]
    return spark.createDataFrame(rows, "code string, department string, province string, district string, zone string, aliases array<string>, weak_aliases array<string>")


def name_index(catalog: DataFrame) -> DataFrame:
    """key, code, weak: every name of every district once, strong before weak."""
    name = lambda c, weak: F.struct(c.alias("name"), F.lit(weak).alias("weak"))
    names = F.concat(F.array(name(F.col("district"), False)), F.transform("aliases", lambda a: name(a, False)), F.transform("weak_aliases", lambda a: name(a, True)))
    return catalog.select("code", F.inline(names)).select(T.key(F.col("name")).alias("key"), "code", "weak").groupBy("key", "code").agg(F.min("weak").alias("weak"))


def partial_districts(fields: DataFrame, index: DataFrame) -> DataFrame:
    """fields' columns and code: districts whose strong name and the field's key are prefixes of each other.

    Both sides are joined on their first MIN_PREFIX letters, so this is an equi-join.
    """
    a = fields.where(F.length("key") >= MIN_PREFIX).withColumn("_p", F.left("key", F.lit(MIN_PREFIX)))
    b = index.where(~F.col("weak") & (F.length("key") >= MIN_PREFIX)).select(F.col("key").alias("name"), "code", F.left("key", F.lit(MIN_PREFIX)).alias("_p"))
    hit = a.join(b, "_p").where(F.startswith("key", F.col("name")) | F.startswith("name", F.col("key")))
    return hit.drop("_p", "name").distinct()


def areas(catalog: DataFrame, level: str) -> DataFrame:
    """key and the entry that stands for each province or department: the first by code."""
    keyed = catalog.withColumn("key", T.key(F.col(level)))
    first = Window.partitionBy("key").orderBy("code")
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def lookup(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each of ``asked`` (key, ...) with the codes of the districts of that name, and whether it names a province or a department."""
    hits = name_index(catalog).groupBy("key").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    area = lambda level: areas(catalog, level).select("key", F.lit(True).alias(f"is_{level}"))
    d = asked.join(hits, "key", "left").join(area("province"), "key", "left").join(area("department"), "key", "left")
    return d.select(*asked.columns, F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.coalesce("is_province", F.lit(False)).alias("is_province"), F.coalesce("is_department", F.lit(False)).alias("is_department"))


def nesting(catalog: DataFrame) -> DataFrame:
    """inner_key, outer_key: which name may stand before which at the end of an address: a district before its province or department, a province before its department, a name before itself."""
    place = catalog.select("code", T.key(F.col("province")).alias("pk"), T.key(F.col("department")).alias("dk"))
    named = name_index(catalog).join(place, "code")
    pairs = F.array(*[F.struct(F.col(a).alias("inner_key"), F.col(b).alias("outer_key")) for a, b in (("key", "pk"), ("key", "dk"), ("pk", "dk"), ("key", "key"), ("pk", "pk"), ("dk", "dk"))])
    return named.select(F.inline(pairs)).distinct()


def clean_name(name: Column) -> tuple[Column, Column]:
    """Name and alias of an official district name: underscores are spaces, and ``NAME (ALIAS)`` gives both."""
    clean = T.collapse(F.upper(F.replace(name, F.lit("_"), F.lit(" "))))
    both = r"^(.*?)\s*\(([^)]*)\)\s*$"
    paired = clean.rlike(both)
    return F.when(paired, F.regexp_extract(clean, both, 1)).otherwise(clean), F.when(paired, F.regexp_extract(clean, both, 2)).otherwise("")


def merge_seed(official: DataFrame, seed: DataFrame) -> DataFrame:
    """Official rows with the seed's accents (where names agree by key), zone and aliases."""
    s = seed.select(F.col("code"), *[F.col(c).alias(f"s_{c}") for c in ("district", "zone", "aliases", "weak_aliases")])
    same = T.key(F.col("district")) == T.key(F.col("s_district"))
    part = lambda n: F.substring("code", 1, n)
    zone = F.when(part(4) == "1501", "LIMA_METRO").when(part(4) == "0701", "CALLAO").when(part(2) == "15", "LIMA_PROVINCIAS").otherwise(F.replace(T.key(F.col("department")), F.lit(" "), F.lit("_")))
    joined = official.join(s, "code", "left")
    none = F.array().cast("array<string>")

    def both(c: str) -> Column:
        """The aliases of both, those of equal key once, as first written."""
        every = F.concat(F.coalesce(F.col(c), none), F.coalesce(F.col(f"s_{c}"), none))
        return F.filter(every, lambda x, i: F.array_position(F.transform(every, T.key), T.key(x)) == i + 1)

    return joined.select("code", "department", "province", F.when(same, F.col("s_district")).otherwise(F.col("district")).alias("district"), F.coalesce(F.nullif(F.col("s_zone"), F.lit("")), zone).alias("zone"), both("aliases").alias("aliases"), both("weak_aliases").alias("weak_aliases"))
