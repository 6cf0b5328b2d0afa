"""The normalizer's rules by example: what each rule must make of a text, and the catalog's lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat, normalize as norm
from . import fixtures as X
from .queries import query

#: Code, department, province, district, zone, aliases, weak aliases.
CATALOG = (
    ("150101", "Lima", "Lima", "Lima", "LIMA", (), ()), ("150103", "Lima", "Lima", "Ate", "LIMA", ("Vitarte",), ()), ("150110", "Lima", "Lima", "Comas", "LIMA", (), ()),
    ("150122", "Lima", "Lima", "Miraflores", "LIMA", (), ()), ("150132", "Lima", "Lima", "San Juan de Lurigancho", "LIMA", ("SJL",), ()), ("150133", "Lima", "Lima", "San Juan de Miraflores", "LIMA", (), ()),
    ("150120", "Lima", "Lima", "Magdalena del Mar", "LIMA", (), ("Magdalena",)), ("150121", "Lima", "Lima", "Pueblo Libre", "LIMA", (), ("Magdalena",)),
    ("040110", "Arequipa", "Arequipa", "Miraflores", "AREQUIPA", (), ()), ("070102", "Callao", "Callao", "Bellavista", "CALLAO", (), ()),
)
ENTRIES = [dict(zip(("code", "department", "province", "district", "zone", "aliases", "weak_aliases"), e)) for e in CATALOG]
COLUMNS = ("street_type", "street_name", "number", "interior", "block", "lot", "urbanization", "reference", "loc_ubigeo", "loc_province", "loc_source", "match_key")

#: Rule, address, structured fields, the parts read (all others empty; the source of no place is NONE), flags in order.
CASES = (
    ('N01', 'Envío domicilio - Av. Los Pinos 100', {}, {'street_type': 'AVENIDA', 'street_name': 'LOS PINOS', 'number': '100', 'loc_source': 'NONE', 'match_key': 'AVENIDA|LOS PINOS|100'}, 'NOISE_PREFIX_REMOVED LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N01', 'Compra y recoge: Jr. Las Flores 22', {}, {'street_type': 'JIRON', 'street_name': 'LAS FLORES', 'number': '22', 'loc_source': 'NONE', 'match_key': 'JIRON|LAS FLORES|22'}, 'NOISE_PREFIX_REMOVED LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N02', 'Calle Norte 12 (frente al parque) (puerta verde)', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'reference': 'FRENTE AL PARQUE PUERTA VERDE', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'LOCATION_UNKNOWN'),
    ('N03', 'Av. Los Pinos S / N', {}, {'street_type': 'AVENIDA', 'street_name': 'LOS PINOS', 'number': 'S/N', 'loc_source': 'NONE', 'match_key': 'AVENIDA|LOS PINOS|S/N'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED NO_NUMBER'),
    ('N03', 'Av. Los Pinos N° 35', {}, {'street_type': 'AVENIDA', 'street_name': 'LOS PINOS', 'number': '35', 'loc_source': 'NONE', 'match_key': 'AVENIDA|LOS PINOS|35'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N03', 'Mz B Lt 4 A.A.H.H. Sol Naciente', {}, {'block': 'B', 'lot': '4', 'urbanization': 'ASENTAMIENTO HUMANO SOL NACIENTE', 'loc_source': 'NONE', 'match_key': 'MZ:B|LT:4|URB:ASENTAMIENTO HUMANO SOL NACIENTE'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N03', 'Mz B Lt 4 Asent. Hum. Sol Naciente', {}, {'block': 'B', 'lot': '4', 'urbanization': 'ASENTAMIENTO HUMANO SOL NACIENTE', 'loc_source': 'NONE', 'match_key': 'MZ:B|LT:4|URB:ASENTAMIENTO HUMANO SOL NACIENTE'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N03', 'Mz B Lt 4 A.P.V. Sol Naciente', {}, {'block': 'B', 'lot': '4', 'urbanization': 'ASOCIACION PRO VIVIENDA SOL NACIENTE', 'loc_source': 'NONE', 'match_key': 'MZ:B|LT:4|URB:ASOCIACION PRO VIVIENDA SOL NACIENTE'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N03', 'Mz B Lt 4 P.J. Sol Naciente', {}, {'block': 'B', 'lot': '4', 'urbanization': 'PUEBLO JOVEN SOL NACIENTE', 'loc_source': 'NONE', 'match_key': 'MZ:B|LT:4|URB:PUEBLO JOVEN SOL NACIENTE'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N04', 'Calle Norte 8 3er piso', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '8', 'interior': 'PISO 3', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|8'}, 'LOCATION_UNKNOWN'),
    ('N04', 'Calle Norte 8 segundo piso', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '8', 'interior': 'PISO 2', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|8'}, 'LOCATION_UNKNOWN'),
    ('N04', 'Calle Norte 8 piso 3 201', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '8', 'interior': 'PISO 3', 'reference': '201', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|8'}, 'LOCATION_UNKNOWN TRAILING_TEXT_MOVED_TO_REFERENCE'),
    ('N05', 'Calle Norte 12-B', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12B', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12B'}, 'LOCATION_UNKNOWN'),
    ('N05', 'Calle Norte 12 B-204', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'interior': 'B204', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'LOCATION_UNKNOWN INTERIOR_FROM_BARE_NUMBER'),
    ('N05', 'Calle Norte 302-Miraflores', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '302', 'loc_ubigeo': '150122', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|302'}, 'DISTRICT_BY_ACTIVE_ZONE'),
    ('N06', 'Mz A Lt 1 Asociación pro vivienda El Sol', {}, {'block': 'A', 'lot': '1', 'urbanization': 'ASOCIACION PRO VIVIENDA EL SOL', 'loc_source': 'NONE', 'match_key': 'MZ:A|LT:1|URB:ASOCIACION PRO VIVIENDA EL SOL'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N06', 'Calle ¡Norte! sin nro.', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': 'S/N', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|S/N'}, 'LOCATION_UNKNOWN NO_NUMBER'),
    ('N07', 'MZALT3 Urb El Sol', {}, {'block': 'A', 'lot': '3', 'urbanization': 'URBANIZACION EL SOL', 'loc_source': 'NONE', 'match_key': 'MZ:A|LT:3|URB:URBANIZACION EL SOL'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N07', 'Mza J Lt5 Urb El Sol', {}, {'block': 'J', 'lot': '5', 'urbanization': 'URBANIZACION EL SOL', 'loc_source': 'NONE', 'match_key': 'MZ:J|LT:5|URB:URBANIZACION EL SOL'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N07', 'Calle Norte sn Urb El Sol', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': 'S/N', 'urbanization': 'URBANIZACION EL SOL', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|S/N|URB:URBANIZACION EL SOL'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED NO_NUMBER'),
    ('N08', 'Av. Los Pinos 100 Av. Los Pinos 100', {}, {'street_type': 'AVENIDA', 'street_name': 'LOS PINOS', 'number': '100', 'loc_source': 'NONE', 'match_key': 'AVENIDA|LOS PINOS|100'}, 'DUPLICATED_TEXT LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N08', 'Calle Norte 25 Ate Calle Norte 25 At', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '25', 'loc_ubigeo': '150103', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|25'}, 'DUPLICATED_TEXT'),
    ('N09', 'Calle Norte 12 al costado de la bodega', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'reference': 'AL COSTADO DE LA BODEGA', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'LOCATION_UNKNOWN'),
    ('N09', 'Calle Norte 12 frente al grifo', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'reference': 'FRENTE AL GRIFO', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'LOCATION_UNKNOWN'),
    ('N09', 'Calle Norte 12 casa verde', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'reference': 'CASA VERDE', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'LOCATION_UNKNOWN'),
    ('N10', 'Calle Norte 12, Ate, Perú', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150103', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, 'COUNTRY_REMOVED'),
    ('N10', 'Calle Norte 12, Lima 20', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'POSTAL_CODE_IN_TEXT LOCATION_UNKNOWN'),
    ('N10', 'Calle Norte 12 150103', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'UBIGEO_IN_TEXT LOCATION_UNKNOWN'),
    ('N10', 'Calle Norte 12 15023', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'POSTAL_CODE_IN_TEXT LOCATION_UNKNOWN'),
    ('N11', 'Comas Urb El Sol Mz A Lt 2', {'district': 'Comas'}, {'block': 'A', 'lot': '2', 'urbanization': 'URBANIZACION EL SOL', 'loc_ubigeo': '150110', 'loc_province': 'Lima', 'loc_source': 'FIELD', 'match_key': 'MZ:A|LT:2|URB:URBANIZACION EL SOL'}, 'DISTRICT_PREFIX_REMOVED NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N11', 'Clínica San Pablo - Av. Norte 77', {}, {'street_type': 'AVENIDA', 'street_name': 'NORTE', 'number': '77', 'reference': 'CLINICA SAN PABLO', 'loc_source': 'NONE', 'match_key': 'AVENIDA|NORTE|77'}, 'ESTABLISHMENT_PREFIX LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N12', 'Los Pinos 340 Avenida', {}, {'street_name': 'LOS PINOS', 'number': '340', 'reference': 'AVENIDA', 'loc_source': 'NONE', 'match_key': 'LOS PINOS|340'}, 'LOCATION_UNKNOWN NO_STREET_TYPE'),
    ('N12', 'Los Pinos 340 C', {}, {'street_name': 'LOS PINOS', 'number': '340C', 'loc_source': 'NONE', 'match_key': 'LOS PINOS|340C'}, 'LOCATION_UNKNOWN NO_STREET_TYPE'),
    ('N13', 'Jr. Norte 12 Torre B', {}, {'street_type': 'JIRON', 'street_name': 'NORTE', 'number': '12', 'interior': 'TORRE B', 'loc_source': 'NONE', 'match_key': 'JIRON|NORTE|12'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N13', 'Av. Víctor de la Torre 12', {}, {'street_type': 'AVENIDA', 'street_name': 'VICTOR DE LA TORRE', 'number': '12', 'loc_source': 'NONE', 'match_key': 'AVENIDA|VICTOR DE LA TORRE|12'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N13', 'Calle Casa Blanca 15', {}, {'street_type': 'CALLE', 'street_name': 'CASA BLANCA', 'number': '15', 'loc_source': 'NONE', 'match_key': 'CALLE|CASA BLANCA|15'}, 'LOCATION_UNKNOWN'),
    ('N14', 'Mz Ñ Lt 2 Urb El Sol', {}, {'block': 'Ñ', 'lot': '2', 'urbanization': 'URBANIZACION EL SOL', 'loc_source': 'NONE', 'match_key': 'MZ:Ñ|LT:2|URB:URBANIZACION EL SOL'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N15', 'Calle Norte Urb El Sol 125', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '125', 'urbanization': 'URBANIZACION EL SOL', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|125|URB:URBANIZACION EL SOL'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED NUMBER_AFTER_URBANIZATION'),
    ('N15', 'Calle Norte 12 Urb El Sol B204', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'interior': 'B204', 'urbanization': 'URBANIZACION EL SOL', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12|URB:URBANIZACION EL SOL'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED INTERIOR_CODE_AFTER_URBANIZATION'),
    ('N16', 'Mz C Lt 8 Los Nogales 345', {}, {'street_name': 'LOS NOGALES', 'number': '345', 'block': 'C', 'lot': '8', 'loc_source': 'NONE', 'match_key': 'LOS NOGALES|345|MZ:C|LT:8'}, 'LOCATION_UNKNOWN NO_STREET_TYPE STREET_AFTER_BLOCK'),
    ('N16', 'Mz C Lt 8 Los Nogales', {}, {'block': 'C', 'lot': '8', 'urbanization': 'LOS NOGALES', 'loc_source': 'NONE', 'match_key': 'MZ:C|LT:8|URB:LOS NOGALES'}, 'LOCATION_UNKNOWN NO_STREET_TYPE URBANIZATION_WITHOUT_MARKER'),
    ('N16', 'Mz C Lt 8 2da Etapa Urb El Sol', {}, {'block': 'C', 'lot': '8', 'urbanization': 'URBANIZACION EL SOL 2 ETAPA', 'loc_source': 'NONE', 'match_key': 'MZ:C|LT:8|URB:URBANIZACION EL SOL 2 ETAPA'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N17', 'Urb El Sol Calle Norte 12', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'urbanization': 'URBANIZACION EL SOL', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12|URB:URBANIZACION EL SOL'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N17', 'Mz A Lt 2 Jr. Norte 12', {}, {'street_type': 'JIRON', 'street_name': 'NORTE', 'number': '12', 'block': 'A', 'lot': '2', 'loc_source': 'NONE', 'match_key': 'JIRON|NORTE|12|MZ:A|LT:2'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N18', 'Mz A Lt 2 Urb El Sol Tercera Etapa', {}, {'block': 'A', 'lot': '2', 'urbanization': 'URBANIZACION EL SOL 3 ETAPA', 'loc_source': 'NONE', 'match_key': 'MZ:A|LT:2|URB:URBANIZACION EL SOL 3 ETAPA'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N18', 'Mz A Lt 2 Urb El Sol 3ra etapa', {}, {'block': 'A', 'lot': '2', 'urbanization': 'URBANIZACION EL SOL 3 ETAPA', 'loc_source': 'NONE', 'match_key': 'MZ:A|LT:2|URB:URBANIZACION EL SOL 3 ETAPA'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N18', 'Mz A Lt 2 Urb Primera de Mayo', {}, {'block': 'A', 'lot': '2', 'urbanization': 'URBANIZACION PRIMERA DE MAYO', 'loc_source': 'NONE', 'match_key': 'MZ:A|LT:2|URB:URBANIZACION PRIMERA DE MAYO'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N19', 'Calle Norte 8 Dpto 3 Dpto 3', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '8', 'interior': 'DPTO 3', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|8'}, 'LOCATION_UNKNOWN'),
    ('N19', 'Calle Norte 8 Dpto Int 4 Dpto 3', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '8', 'interior': 'INT 4 DPTO 3', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|8'}, 'LOCATION_UNKNOWN MISSING_UNIT_VALUE'),
    ('N20', 'Mz A Lt 2 Urb El Sol Comas 2', {'ubigeo': '150110'}, {'block': 'A', 'lot': '2', 'urbanization': 'URBANIZACION EL SOL', 'loc_ubigeo': '150110', 'loc_province': 'Lima', 'loc_source': 'UBIGEO', 'match_key': 'MZ:A|LT:2|URB:URBANIZACION EL SOL'}, 'NO_STREET_TYPE ABBREVIATION_EXPANDED DISTRICT_REMOVED_FROM_URBANIZATION'),
    ('N21', 'Mz A Lt 2 Urb Villa Comas', {'ubigeo': '150101'}, {'block': 'A', 'lot': '2', 'urbanization': 'URBANIZACION VILLA COMAS', 'loc_ubigeo': '150101', 'loc_province': 'Lima', 'loc_source': 'UBIGEO', 'match_key': 'MZ:A|LT:2|URB:URBANIZACION VILLA COMAS'}, 'DISTRICT_NAME_IN_TEXT NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N21', 'Mz A Lt 2 Urb El Sol Sector 2 Comas', {}, {'block': 'A', 'lot': '2', 'urbanization': 'URBANIZACION EL SOL SECTOR 2', 'loc_ubigeo': '150110', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'MZ:A|LT:2|URB:URBANIZACION EL SOL SECTOR 2'}, 'NO_STREET_TYPE ABBREVIATION_EXPANDED'),
    ('N22', 'Calle 7 de Junio 120', {}, {'street_type': 'CALLE', 'street_name': '7 DE JUNIO', 'number': '120', 'loc_source': 'NONE', 'match_key': 'CALLE|7 DE JUNIO|120'}, 'LOCATION_UNKNOWN'),
    ('N22', 'Calle Norte 120 A', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '120A', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|120A'}, 'LOCATION_UNKNOWN'),
    ('N22', 'Calle Norte 120 B204', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '120', 'interior': 'B204', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|120'}, 'LOCATION_UNKNOWN INTERIOR_FROM_BARE_NUMBER'),
    ('N23', 'Av. Mcal. Gral. Sta. Rosa 10', {}, {'street_type': 'AVENIDA', 'street_name': 'MARISCAL GENERAL SANTA ROSA', 'number': '10', 'loc_source': 'NONE', 'match_key': 'AVENIDA|MARISCAL GENERAL SANTA ROSA|10'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N23', 'Calle Dr', {}, {'street_type': 'CALLE', 'street_name': 'DR', 'loc_source': 'NONE', 'match_key': 'CALLE|DR'}, 'LOCATION_UNKNOWN NO_NUMBER'),
    ('N24', 'Calle Norte', {'number': '125'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '125', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|125'}, 'LOCATION_UNKNOWN NUMBER_FROM_FIELD'),
    ('N24', 'Calle Norte 12', {'number': '125'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'LOCATION_UNKNOWN NUMBER_FIELD_CONFLICT'),
    ('N24', 'Calle Norte', {'number': 'abc'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE'}, 'LOCATION_UNKNOWN NUMBER_FIELD_INVALID NO_NUMBER'),
    ('N24', 'Calle Norte', {'number': '0'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': 'S/N', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|S/N'}, 'LOCATION_UNKNOWN NUMBER_FROM_FIELD'),
    ('N25', 'Jr. Ñaña Huánuco 12 Mz B Lt 3 Dpto 4 Urb La Viña', {}, {'street_type': 'JIRON', 'street_name': 'ÑAÑA HUANUCO', 'number': '12', 'interior': 'DPTO 4', 'block': 'B', 'lot': '3', 'urbanization': 'URBANIZACION LA VIÑA', 'loc_source': 'NONE', 'match_key': 'JIRON|NANA HUANUCO|12|MZ:B|LT:3|URB:URBANIZACION LA VINA'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED'),
    ('N26', 'Av Norte', {}, {'street_type': 'AVENIDA', 'street_name': 'NORTE', 'loc_source': 'NONE', 'match_key': 'AVENIDA|NORTE'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED NO_NUMBER'),
    ('N27', 'Envío domicilio - Av. Mcal. Cáceres N° 12-B 2do piso, Urb. El Sol, Ate, Lima, Perú (portón)', {'reference': 'Casa azul.'}, {'street_type': 'AVENIDA', 'street_name': 'MARISCAL CACERES', 'number': '12B', 'interior': 'PISO 2', 'urbanization': 'URBANIZACION EL SOL', 'reference': 'PORTON CASA AZUL', 'loc_ubigeo': '150103', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'AVENIDA|MARISCAL CACERES|12B|URB:URBANIZACION EL SOL'}, 'NOISE_PREFIX_REMOVED COUNTRY_REMOVED ABBREVIATION_EXPANDED'),
    ('L04', 'Calle Norte 12 Ate Lima Lima', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150103', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, ''),
    ('L04', 'Calle Norte 12 Bellavista Lima', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'reference': 'BELLAVISTA', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, 'AMBIGUOUS_LIMA TRAILING_TEXT_MOVED_TO_REFERENCE'),
    ('L04', 'Calle Comas 12', {}, {'street_type': 'CALLE', 'street_name': 'COMAS', 'number': '12', 'loc_source': 'NONE', 'match_key': 'CALLE|COMAS|12'}, 'LOCATION_UNKNOWN'),
    ('L05', 'Av. La Marina 12 La Comas', {}, {'street_type': 'AVENIDA', 'street_name': 'LA MARINA', 'number': '12', 'reference': 'LA COMAS', 'loc_source': 'NONE', 'match_key': 'AVENIDA|LA MARINA|12'}, 'LOCATION_UNKNOWN ABBREVIATION_EXPANDED TRAILING_TEXT_MOVED_TO_REFERENCE'),
    ('L05', 'Urb Los Comas', {}, {'urbanization': 'URBANIZACION LOS COMAS', 'loc_source': 'NONE', 'match_key': 'URB:URBANIZACION LOS COMAS'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED DISTRICT_NAME_IN_URBANIZATION NO_NUMBER'),
    ('L06', 'Calle Norte 12, Miraflores, Arequipa', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '040110', 'loc_province': 'Arequipa', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, ''),
    ('L07', 'Calle Norte 12, Miraflores', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150122', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, 'DISTRICT_BY_ACTIVE_ZONE'),
    ('L08', 'Calle Norte 12, Callao', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_province': 'Callao', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, 'AMBIGUOUS_CALLAO'),
    ('L08', 'Calle Norte 12, Lima', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, 'AMBIGUOUS_LIMA'),
    ('L09', 'Calle Norte 12, Miraflores, Lima, Lima', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150122', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, ''),
    ('L09', 'Calle Norte 12, Lima, Lima', {}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, 'AMBIGUOUS_LIMA'),
    ('L10', 'Calle Norte 12, Miraflores', {'province': 'Arequipa'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '040110', 'loc_province': 'Arequipa', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, ''),
    ('L11', 'Calle Norte 12', {'district': 'Miraflores', 'province': 'Arequipa'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '040110', 'loc_province': 'Arequipa', 'loc_source': 'FIELD', 'match_key': 'CALLE|NORTE|12'}, ''),
    ('L11', 'Calle Norte 12', {'district': 'Comas', 'province': 'Callao'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150110', 'loc_province': 'Lima', 'loc_source': 'FIELD', 'match_key': 'CALLE|NORTE|12'}, 'LOCATION_INCONSISTENT'),
    ('L11', 'Calle Norte 12', {'district': 'Magdalena'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'AMBIGUOUS_DISTRICT LOCATION_UNKNOWN'),
    ('L11', 'Calle Norte 12', {'district': 'Nada', 'province': 'Tampoco', 'department': 'Menos'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'UNKNOWN_DISTRICT UNKNOWN_PROVINCE UNKNOWN_DEPARTMENT LOCATION_UNKNOWN'),
    ('L11', 'Calle Norte 12', {'province': 'Callao'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_province': 'Callao', 'loc_source': 'FIELD', 'match_key': 'CALLE|NORTE|12'}, ''),
    ('L11', 'Calle Norte 12', {'department': 'Arequipa'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_source': 'FIELD', 'match_key': 'CALLE|NORTE|12'}, ''),
    ('L11', 'Calle Norte 12', {'district': 'San Juan de Lurig'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150132', 'loc_province': 'Lima', 'loc_source': 'FIELD', 'match_key': 'CALLE|NORTE|12'}, 'DISTRICT_FIELD_PARTIAL'),
    ('L12', 'Calle Norte 12, Comas', {'ubigeo': '150103', 'district': 'Ate'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150103', 'loc_province': 'Lima', 'loc_source': 'UBIGEO', 'match_key': 'CALLE|NORTE|12'}, 'DISTRICT_CONFLICT'),
    ('L12', 'Calle Norte 12', {'ubigeo': '999999'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_source': 'NONE', 'match_key': 'CALLE|NORTE|12'}, 'INVALID_UBIGEO LOCATION_UNKNOWN'),
    ('L12', 'Calle Norte 12, Comas', {'district': 'Ate'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150103', 'loc_province': 'Lima', 'loc_source': 'FIELD', 'match_key': 'CALLE|NORTE|12'}, 'DISTRICT_CONFLICT'),
    ('L12', 'Calle Norte 12, Comas', {'district': 'Lima'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150110', 'loc_province': 'Lima', 'loc_source': 'TEXT', 'match_key': 'CALLE|NORTE|12'}, 'GENERIC_DISTRICT_FIELD'),
    ('L13', 'Calle Norte 12', {'ubigeo': '150103', 'district': 'Comas'}, {'street_type': 'CALLE', 'street_name': 'NORTE', 'number': '12', 'loc_ubigeo': '150103', 'loc_province': 'Lima', 'loc_source': 'UBIGEO', 'match_key': 'CALLE|NORTE|12'}, 'DISTRICT_CONFLICT'),
    ('L14', 'Mz A Lt 2 Urb El Sol de Comas 3', {}, {'block': 'A', 'lot': '2', 'urbanization': 'URBANIZACION EL SOL DE COMAS 3', 'loc_source': 'NONE', 'match_key': 'MZ:A|LT:2|URB:URBANIZACION EL SOL DE COMAS 3'}, 'LOCATION_UNKNOWN NO_STREET_TYPE ABBREVIATION_EXPANDED DISTRICT_NAME_IN_URBANIZATION'),
)


def literal(value) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _expected() -> str:
    rows = [(i, rule, *[parts.get(c, "") for c in COLUMNS], flags) for i, (rule, _, _, parts, flags) in enumerate(CASES)]
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v(case_no, rule, {', '.join(COLUMNS)}, flags)"


@query(_expected())
def normalize_rules(spark, sf_dir):
    rows = [(i, rule, address, *[fields.get(f, "") for f in norm.FIELDS[1:]]) for i, (rule, address, fields, _, _) in enumerate(CASES)]
    asked = spark.createDataFrame(rows, f"case_no int, rule string, {', '.join(f'{f} string' for f in norm.FIELDS)}")
    return norm.normalize(asked, ENTRIES, frozenset({"LIMA"})).select("case_no", "rule", *COLUMNS, F.array_join("flags", " ").alias("flags"))


# -- the catalog -----------------------------------------------------------------
#: Districts made of nations: codes, provinces and departments by region, names and aliases with accents and repeats.
PLACES = """SELECT lpad(CAST(1501 + n_regionkey * 100 AS VARCHAR(10)), 4, '0') || lpad(CAST(n_nationkey AS VARCHAR(10)), 2, '0') AS code, 'Región ' || CAST(n_regionkey AS VARCHAR(10)) AS department,
'Provincia ' || CAST(n_regionkey % 3 AS VARCHAR(10)) AS province, n_name AS district, CASE WHEN n_nationkey % 2 = 0 THEN 'Z' || CAST(n_regionkey AS VARCHAR(10)) ELSE '' END AS zone,
'Áli ' || CAST(n_nationkey % 7 AS VARCHAR(10)) AS alias, CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE 'Débil ' || CAST(n_nationkey % 4 AS VARCHAR(10)) END AS weak FROM nation"""


def _places(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation")
    return spark.sql(PLACES).select("code", "department", "province", "district", "zone", F.array("alias", F.upper("alias")).alias("aliases"), F.array("weak").alias("weak_aliases"))


INDEX = f"""WITH p AS ({PLACES}), n AS (SELECT code, unnest([district, alias, weak]) AS name, unnest([false, false, true]) AS weak FROM p)
SELECT {X.keyed('name')} AS key, code, min(weak) AS weak FROM n GROUP BY ALL"""


@query(INDEX)
def catalog_index(spark, sf_dir):
    return cat.name_index(_places(spark, sf_dir))


@query(f"""WITH i AS ({INDEX}), p AS ({PLACES}), a AS (SELECT {X.keyed('name')} AS key, level FROM (SELECT unnest([province, department]) AS name, unnest(['province', 'department']) AS level FROM p) GROUP BY ALL),
k AS (SELECT key FROM i UNION SELECT key FROM a UNION SELECT 'NOWHERE')
SELECT key, coalesce((SELECT string_agg(code, ' ' ORDER BY code) FROM i WHERE i.key = k.key), '') AS codes, EXISTS (SELECT 1 FROM a WHERE a.key = k.key AND level = 'province') AS is_province, EXISTS (SELECT 1 FROM a WHERE a.key = k.key AND level = 'department') AS is_department FROM k""")
def catalog_lookup(spark, sf_dir):
    p = _places(spark, sf_dir)
    names = cat.name_index(p).select("key").unionByName(cat.areas(p, "province").select("key")).unionByName(cat.areas(p, "department").select("key"))
    asked = names.unionByName(spark.createDataFrame([("NOWHERE",)], "key string")).distinct()
    return cat.lookup(asked, p).withColumn("codes", F.array_join("codes", " "))


@query(f"WITH p AS ({PLACES}) SELECT level, key, min(code) AS code, arg_min(zone, code) AS zone FROM (SELECT code, zone, 'province' AS level, {X.keyed('province')} AS key FROM p UNION ALL SELECT code, zone, 'department', {X.keyed('department')} FROM p) GROUP BY level, key")
def catalog_areas(spark, sf_dir):
    p = _places(spark, sf_dir)
    of = lambda level: cat.areas(p, level).select(F.lit(level).alias("level"), "key", "code", "zone")
    return of("province").unionByName(of("department"))


@query(f"""WITH i AS ({INDEX}), p AS ({PLACES}), a AS (SELECT i.key AS inner_key, {X.keyed('province')} AS pk, {X.keyed('department')} AS dk FROM i JOIN p USING (code))
SELECT DISTINCT inner_key, outer_key FROM (SELECT inner_key, pk AS outer_key FROM a UNION ALL SELECT inner_key, dk FROM a UNION ALL SELECT pk, dk FROM a UNION ALL SELECT inner_key, inner_key FROM a UNION ALL SELECT pk, pk FROM a UNION ALL SELECT dk, dk FROM a)""")
def catalog_nesting(spark, sf_dir):
    return cat.nesting(_places(spark, sf_dir))


SEED = "SELECT code, CASE WHEN CAST(code AS INT) % 3 = 0 THEN 'Otro ' || district ELSE lower(district) END AS district, CASE WHEN CAST(code AS INT) % 4 = 0 THEN 'SEMBRADA' ELSE '' END AS zone, alias, 'Nuevo ' || code AS extra FROM p WHERE CAST(code AS INT) % 2 = 1"


@query(f"""WITH p AS ({PLACES}), s AS ({SEED})
SELECT p.code, CASE WHEN {X.keyed('p.district')} = {X.keyed('s.district')} THEN s.district ELSE p.district END AS district,
CASE WHEN coalesce(s.zone, '') <> '' THEN s.zone WHEN left(p.code, 4) = '1501' THEN 'LIMA_METRO' WHEN left(p.code, 4) = '0701' THEN 'CALLAO' WHEN left(p.code, 2) = '15' THEN 'LIMA_PROVINCIAS' ELSE replace({X.keyed('department')}, ' ', '_') END AS zone,
p.alias || CASE WHEN s.code IS NULL THEN '' ELSE '|' || s.extra END AS aliases FROM p LEFT JOIN s ON p.code = s.code""")
def catalog_merge(spark, sf_dir):
    p = _places(spark, sf_dir)
    p.withColumn("alias", F.element_at("aliases", 1)).createOrReplaceTempView("p")
    seed = spark.sql(SEED).select("code", "district", "zone", F.array(F.upper("alias"), "extra").alias("aliases"), F.lit(None).cast("array<string>").alias("weak_aliases"))
    official = p.withColumn("aliases", F.slice("aliases", 1, 1))
    return cat.merge_seed(official, seed).select("code", "district", "zone", F.array_join("aliases", "|").alias("aliases"))


@query("WITH n AS (SELECT n_nationkey AS id, replace(n_name, '_', ' ') AS n FROM nation) SELECT id, CASE id % 3 WHEN 1 THEN n || ' VIEJO' ELSE n END AS name, CASE id % 3 WHEN 2 THEN 'EL ' || n ELSE '' END AS alias FROM n")
def catalog_clean_names(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey") % 3
    raw = F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat("n_name", F.lit("__viejo "))).otherwise(F.concat(F.lit(" "), "n_name", F.lit(" (el "), F.lower("n_name"), F.lit(")")))
    name, alias = cat.clean_name(raw)
    return n.select(F.col("n_nationkey").alias("id"), name.alias("name"), alias.alias("alias"))
