import pytest

from callejero.operators.catalog import Catalog
from callejero.operators.normalize import Normalizer, key, phonetic

ENTRIES = [
    {"code": c, "department": dep, "province": prov, "district": d, "zone": z, "aliases": a, "weak_aliases": w}
    for c, dep, prov, d, z, a, w in [
        ("150101", "Lima", "Lima", "Lima", "LIMA", [], []), ("150103", "Lima", "Lima", "Ate", "LIMA", ["Vitarte"], []), ("150110", "Lima", "Lima", "Comas", "LIMA", [], []),
        ("150122", "Lima", "Lima", "Miraflores", "LIMA", [], []), ("150132", "Lima", "Lima", "San Juan de Lurigancho", "LIMA", ["SJL"], []), ("150133", "Lima", "Lima", "San Juan de Miraflores", "LIMA", [], []),
        ("150120", "Lima", "Lima", "Magdalena del Mar", "LIMA", [], ["Magdalena"]), ("150121", "Lima", "Lima", "Pueblo Libre", "LIMA", [], ["Magdalena"]),
        ("040110", "Arequipa", "Arequipa", "Miraflores", "AREQUIPA", [], []), ("070102", "Callao", "Callao", "Bellavista", "CALLAO", [], []),
    ]
]
READ = Normalizer(Catalog(ENTRIES), frozenset({"LIMA"}))


def read(address, **fields):
    return READ({**dict.fromkeys(("district", "province", "department", "ubigeo", "number", "reference"), ""), "address": address, **fields})


@pytest.mark.parametrize(
    "address, fields, expected, flags",
    [
        ("Clle. Los Sáuces #245, Ate", {}, {"street_type": "CALLE", "street_name": "LOS SAUCES", "number": "245", "loc_ubigeo": "150103"}, ["ABBREVIATION_EXPANDED"]),
        ("Calle 5 Mz A Lt 3 Urb Los Rosales SJL", {}, {"street_name": "5", "block": "A", "lot": "3", "urbanization": "URBANIZACION LOS ROSALES", "loc_ubigeo": "150132"}, []),
        ("Av. Arequipa s/n", {"district": "Miraflores", "province": "Lima", "department": "Lima"}, {"street_name": "AREQUIPA", "number": "S/N", "loc_ubigeo": "150122"}, ["NO_NUMBER"]),
        ("Los Laureles 610 204", {}, {"number": "610", "interior": "204"}, ["INTERIOR_FROM_BARE_NUMBER"]),
        ("Los Laureles 912 912", {}, {"number": "912", "interior": ""}, ["REPEATED_NUMBER"]),
        ("Los Laureles 120 B204", {}, {"number": "120", "interior": "B204"}, []),
        ("Jr. 2 de Mayo 340", {}, {"street_name": "2 DE MAYO", "number": "340"}, []),
        ("Mz A Lote 02 C", {}, {"lot": "02C"}, []),
        ("Mz A Lote 12, 12", {}, {"lot": "12"}, ["REPEATED_VALUE"]),
        ("Mza. J Lt 1", {}, {"block": "J"}, []),
        ("MzB Lt 1", {}, {"block": "B"}, []),
        ("Jr. X sn - Torre 2", {}, {"number": "S/N", "interior": "TORRE 2"}, []),
        ("Av. Haya de la Torre 120", {}, {"street_name": "HAYA DE LA TORRE"}, []),
        ("Plaza Norte - Av. X 100", {}, {"street_type": "AVENIDA", "street_name": "X", "reference": "PLAZA NORTE"}, ["ESTABLISHMENT_PREFIX"]),
        ("Urb. Los Rosales-Comas", {}, {"urbanization": "URBANIZACION LOS ROSALES", "loc_ubigeo": "150110"}, []),
        ("Mz H Lote 4 La Esperanza II", {}, {"urbanization": "LA ESPERANZA II"}, ["URBANIZATION_WITHOUT_MARKER"]),
        ("Mz A Lt 3 Etapa 2 Urb. Las Lomas", {}, {"urbanization": "URBANIZACION LAS LOMAS ETAPA 2"}, []),
        ("Etapa 2 Urb. Las Lomas", {}, {"street_name": "ETAPA", "number": "2"}, []),
        ("Calle 5 piso 2", {}, {"street_name": "5", "interior": "PISO 2"}, []),
        ("2do nivel Calle Norte 8", {}, {"interior": "PISO 2", "street_name": "NORTE", "number": "8"}, []),
        ("Av. Arequipa, Lima", {}, {"street_name": "AREQUIPA", "loc_ubigeo": ""}, ["AMBIGUOUS_LIMA"]),
        ("Av. Norte 10, Comas", {"district": "LIMA"}, {"loc_ubigeo": "150110"}, ["GENERIC_DISTRICT_FIELD"]),
        ("Calle 1", {"district": "SAN JUAN DE MIRAFLOR"}, {"loc_ubigeo": "150133"}, ["DISTRICT_FIELD_PARTIAL"]),
        ("Calle Norte 1, Magdalena", {}, {"loc_ubigeo": ""}, ["AMBIGUOUS_DISTRICT"]),
        ("Calle Norte 1, Lima 20", {}, {"street_name": "NORTE", "number": "1"}, ["POSTAL_CODE_IN_TEXT"]),
        ("", {}, {"street_name": "", "normalized": ""}, ["EMPTY_ADDRESS"]),
        ("Av. Los Olivos 100", {"district": "Bellavista", "province": "Callao"}, {"loc_ubigeo": "070102", "in_scope": False}, []),
    ],
)
def test_reading(address, fields, expected, flags):
    r = read(address, **fields)
    assert {k: r[k] for k in expected} == expected
    assert set(flags) <= set(r["flags"])


def test_keys():
    a, b = read("C. Los Sauces 245 Ate"), read("Calle Los Saucez 245 - Ate")
    assert a["match_key"] != b["match_key"] and a["phonetic_key"] == b["phonetic_key"]
    assert key("  San  Martín-de Porres. ") == "SAN MARTIN DE PORRES" and phonetic("Olivos") != phonetic("Olivares")


@pytest.mark.parametrize("address", ["Clle. Los Sáuces #245, Ate", "Calle 5 Mz A Lt 3 Urb Los Rosales SJL", "Jr. 2 de Mayo 340", "Jr. X sn - Torre 2"])
def test_reading_again_changes_nothing(address):
    once = read(address)
    assert read(once["normalized"], ubigeo=once["loc_ubigeo"])["normalized"] == once["normalized"]
