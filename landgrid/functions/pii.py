"""Rules that tell personal data by column name and by value, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from landgrid.functions.text import category_key

# Normalised column names that hold personal data.
EXACT_NAMES = [
    "propietario",
    "propietarios",
    "nombre_propietario",
    "nombres_propietario",
    "propietario_nombre",
    "nombre_del_propietario",
    "titular",
    "titulares",
    "nombre_titular",
    "titular_derecho",
    "titular_catastral",
    "poseedor",
    "nombre_poseedor",
    "ocupante",
    "nombre_ocupante",
    "tenedor",
    "arrendatario",
    "usufructuario",
    "heredero",
    "causante",
    "copropietario",
    "interesado",
    "nombre_interesado",
    "solicitante",
    "nombre_solicitante",
    "responsable_predio",
    "contribuyente",
    "nombre_contribuyente",
    "sujeto_activo",
    "sujeto_pasivo",
    "nombre",
    "nombres",
    "apellido",
    "apellidos",
    "primer_nombre",
    "segundo_nombre",
    "primer_apellido",
    "segundo_apellido",
    "nombre_completo",
    "nombre_persona",
    "nombre_natural",
    "razon_social",
    "razon_social_propietario",
    "nombre_razon_social",
    "documento",
    "documentos",
    "num_documento",
    "numero_documento",
    "nro_documento",
    "documento_identidad",
    "doc_identidad",
    "tipo_documento",
    "tipo_doc",
    "identificacion",
    "num_identificacion",
    "numero_identificacion",
    "nro_identificacion",
    "id_persona",
    "cedula",
    "cedulas",
    "num_cedula",
    "numero_cedula",
    "cedula_ciudadania",
    "cc",
    "cedula_catastral_titular",
    "tarjeta_identidad",
    "cedula_extranjeria",
    "pasaporte",
    "nuip",
    "nit",
    "nit_propietario",
    "num_nit",
    "numero_nit",
    "digito_verificacion",
    "telefono",
    "telefonos",
    "num_telefono",
    "numero_telefono",
    "tel",
    "celular",
    "movil",
    "fax",
    "correo",
    "correos",
    "correo_electronico",
    "email",
    "e_mail",
    "mail",
    "direccion_correspondencia",
    "direccion_notificacion",
    "direccion_notificaciones",
    "direccion_contacto",
    "direccion_residencia",
    "direccion_domicilio",
    "direccion_titular",
    "direccion_propietario",
    "buzon",
    "contacto",
    "nombre_contacto",
    "matricula_titular",
    "matricula_propietario",
    "numero_escritura",
    "escritura",
    "notaria",
    "notario",
    "acto_administrativo_titular",
    "firma",
    "huella",
    "foto",
    "fotografia",
    "genero",
    "sexo",
    "fecha_nacimiento",
    "estado_civil",
    "etnia",
    "discapacidad",
    "usuario",
    "usuario_creacion",
    "usuario_modificacion",
    "usuario_log",
    "usuario_log_creacion",
    "usuario_edicion",
    "created_user",
    "last_edited_user",
    "editor",
    "digitalizador",
    "funcionario",
    "operario",
    "operator",
    "operator_email",
    "operator_phone",
    "contact_phone",
    "contact_mobile",
    "contact_whatsapp",
    "contact_fax",
    "contact_instagram",
    "contact_facebook",
    "contact_twitter",
    "contact_person",
    "addr_street",
    "addr_housenumber",
    "addr_housename",
    "addr_unit",
    "addr_full",
    "addr_flats",
    "addr_door",
    "owner",
    "owner_name",
    "ownername",
    "property_owner",
    "holder",
    "holder_name",
    "taxpayer",
    "taxpayer_name",
    "first_name",
    "last_name",
    "full_name",
    "person_name",
    "national_id",
    "tax_id",
    "phone",
    "phone_number",
    "mobile",
    "cell_phone",
    "contact_email",
    "mailing_address",
    "birth_date",
    "date_of_birth",
    "gender",
    "signature",
    "fingerprint",
]

# Names of places and things that only look personal.
ALLOWED = [
    "^(nombre|nom|nmbr)_?(geografico|geo|toponimo|topon|lugar|sitio|entidad_territorial)",
    "^(nombre|nom)_?(departamento|dpto|depto|municipio|mpio|mun|corregimiento|vereda|barrio|comuna|localidad|sector|manzana|centro_poblado|cpoblado|region|pais|zona|subzona|cuenca|subcuenca|parque|area_protegida|resguardo|consejo_comunitario)",
    "^(nombre|nom)_?(via|vial|calle|carrera|predio|inmueble|proyecto|obra|capa|layer|campo|archivo|fuente|dataset|servicio|tabla|clase|categoria|tipo|unidad|suelo|paisaje|cultivo|especie|institucion|establecimiento|sede|colegio|ips|hospital|empresa|entidad|gestor|gestor_catastral|oficina|direccion_territorial|estacion|embalse|rio|quebrada|humedal|grupo|lote|item|programa|contrato|proceso|producto|medicamento|banco|fondo|plan|actividad|indicador|variable)",
    "^(url|uri|enlace|link|ruta|path)(_|$)",
    "_(url|uri|link|enlace)$",
    "^fecha_?(de_)?firma",
    "^firma_?(del?_)?(contrato|acta|convenio|documento|proceso)",
    "^(departamento|dpto|depto|municipio|mpio)_nombre$",
    "_(geografico|toponimo)$",
    "^nombre_?(1|2|3)?_?(oficial|comun|alterno|anterior)$",
    "^direccion(_predio|_inmueble|_catastral|_oficial|_normalizada)?$",
    "^direccion_?(via|vial|nomenclatura)",
    "^(user|usuario)_?(campo|field|dato|definido)",
]

# Rule id and pattern, first match wins.
NAME_RULES = [
    ("owner", "(propietar|titular|poseedor|ocupante|tenedor|usufructuar|heredero|causante|copropiet)"),
    ("person_name", "(^|_)(nombre|nombres|nom|nomb|apellido|apellidos|apell|apel)(_|$|[0-9])"),
    ("person_name_en", "(^|_)(first|last|middle|full|given|family)_?name(_|$|[0-9])"),
    ("business_name_natural", "(razon_?social|razonsocial)"),
    ("identity_document", "(cedula|c_?dula|nuip|documento|identificacion|ident_?doc|doc_?ident|tarjeta_identidad|ced_?extranj|pasaporte|national_?id)"),
    ("tax_id", "(^|_)(nit|rut|tax_?id)(_|$|[0-9])"),
    ("phone", "(telefono|tel_?fono|(^|_)(tel|telef|celular|movil|cel|fax|phone|mobile)(_|$|[0-9]))"),
    ("email", "(correo|e_?mail|(^|_)mail(_|$|[0-9])|buzon)"),
    ("contact_address", "direccion_?(correspondencia|notificacion|notificaciones|contacto|residencia|domicilio|titular|propietario|envio)|mailing_?address"),
    ("notary_deed", "(notari|escritura_?publica|(^|_)escritura(_|$|[0-9]))"),
    ("biometric", "(huella|firma_?digital|(^|_)firma(_|$)|biometr|fotograf|(^|_)foto(_|$|[0-9]))"),
    ("sensitive_attribute", "(fecha_?nacimiento|birth_?date|date_?of_?birth|estado_?civil|(^|_)(genero|sexo|gender|etnia|raza)(_|$)|discapacidad|orientacion_?sexual|afiliacion_?politica|religion)"),
    ("operator_user", "(^|_)(usuario|user|created_?user|last_?edited_?user|editor|digitalizador|funcionario|operario|operador|responsable)(_|$|[0-9])"),
    ("taxpayer", "(contribuyente|taxpayer|sujeto_?pasivo|deudor|obligado_?tributario)"),
    ("interested_party", "(interesado|solicitante|peticionario|reclamante|demandante|demandado|apoderado)"),
]
ADJACENT_NAMES = ["matricula_inmobiliaria", "matricula", "nro_matricula", "numero_matricula", "folio_matricula", "fmi"]

# Column names whose numbers are codes or measures, not people.
CODE_NAMES = (
    "(^|_)(fid|oid|objectid|globalid|clave|llave|key|npn|cod_?predial|matricula|manzana|vereda|sector|barrio|comuna|terreno|zona|divipola|dane|dpto|depto|departamento|municipio|mpio|area|areas|superficie|perimetro|longitud|latitud|len|leng|length|shape|cantidad|conteo|total|orden|version|anio|ano|year|vigencia|piso|pisos|altura|habitaciones|banos|poblacion|pop|hogares|viviendas|valor|avaluo|escala|resolucion|hectareas|has|m2|km2)(_|$|[0-9])|^(codigo|cod|id|num|numero|nro|secuencial|pk)"
)

# Shapes of values, first match wins. Digits are spelled [0-9] and a word border
# as one between ASCII word characters and anything else, because Java's \\b takes all letters
# for words while other engines take those of ASCII; so all engines agree on accented names.
BORDER = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = (
    r"(?<![0-9])(?:\+?57[\s.-]?)?(?:\(?(?:60[1-8]|3[0-9]{2})\)?[\s.-]?)[0-9]{3}[\s.-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9])3[0-9]{9}(?![0-9])"
)
VALUE_RULES = [
    ("email", EMAIL),
    ("co_nit", r"(?<![0-9.-])[0-9]{3}[.]?[0-9]{3}[.]?[0-9]{3}\s?-\s?[0-9](?![0-9-])"),
    ("co_phone", PHONE),
    ("co_cedula", r"(?<![0-9.,-])[0-9]{1,3}(?:\.[0-9]{3}){1,3}(?![0-9.,-])|(?<![0-9.,-])[0-9]{6,10}(?![0-9.,-])"),
    ("person_full_name", BORDER + r"(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,}\s+){2,}(?:DE\s+|DEL\s+|LA\s+|LOS\s+)?[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,}" + BORDER),
]
#: The same finds as ``VALUE_RULES`` by shorter ways: one character before the sign is as good as all
#: of them, and a first character that no find begins with is passed without looking around.
FIRST_OF = {"co_nit": "[0-9]", "co_phone": "[+(356]", "co_cedula": "[0-9]", "person_full_name": "[A-ZÁÉÍÓÚÑ]"}
VALUE_SEARCH = {"email": EMAIL.replace("+@", "@", 1)} | {rule: f"(?={FIRST_OF[rule]})(?:{pattern})" for rule, pattern in VALUE_RULES if rule in FIRST_OF}
#: A character that every find of a rule holds.
SIGNS = {"email": "@", "co_nit": "-"}
#: No code of digits is longer; the patterns of codes try every place of longer texts in vain.
LONGEST_CODE = 64
NUMBER_RULES = ["co_cedula", "co_phone"]
HARMLESS = [
    "^[0-9]{20}$|^[0-9]{30}$",
    r"^\{?[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\}?$",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "^-?[0-9]+[.,][0-9]+$",
]


def name_rule(name: Column) -> Column:
    """Id of the rule that marks a column name as personal, NULL for none."""
    key = category_key(name)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | key.rlike(pattern)
    chain = F.when(key == "", None).when(key.isin(EXACT_NAMES), "exact").when(allowed, None)
    for rule, pattern in NAME_RULES:
        chain = chain.when(key.rlike(pattern), rule)
    return chain


def name_rule_of(name: str) -> str | None:
    """``name_rule`` of one known name, without a Spark job."""
    plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    key = re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")
    if not key:
        return None
    if key in EXACT_NAMES:
        return "exact"
    if any(re.search(pattern, key) for pattern in ALLOWED):
        return None
    return next((rule for rule, pattern in NAME_RULES if re.search(pattern, key)), None)


def is_adjacent(name: Column) -> Column:
    """TRUE for names that only turn personal next to a holder's name."""
    return name_rule(name).isNull() & category_key(name).isin(ADJACENT_NAMES)


def value_rule(value: Column, name: Column | None = None) -> Column:
    """Id of the rule that finds personal data in a value, NULL for none.

    Values of any length are scanned in full. Columns named like codes or
    measures skip the number rules.
    """
    text = F.trim(value)
    skip = text == ""
    for pattern in HARMLESS[:2]:
        skip = skip | ((F.length(text) <= LONGEST_CODE) & text.rlike(pattern))
    for pattern in HARMLESS[2:]:
        skip = skip | text.rlike(pattern)
    code_like = F.lit(False) if name is None else category_key(name).rlike(CODE_NAMES)
    chain = F.when(skip, None)
    for rule, _ in VALUE_RULES:
        hit = text.rlike(VALUE_SEARCH[rule])
        hit = text.contains(SIGNS[rule]) & hit if rule in SIGNS else hit
        chain = chain.when(hit & ~code_like if rule in NUMBER_RULES else hit, rule)
    return chain


def redacted(rule: Column) -> Column:
    return F.concat(F.lit("[REDACTADO:"), rule, F.lit("]"))
