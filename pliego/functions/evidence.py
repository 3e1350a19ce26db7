"""Evidence as JSON text, for rows whose flags carry different columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pliego.functions.text import decimals, percent, pesos, spanish_date
from pliego.params import Params

#: Label and kind of every evidence key; other keys are shown humanised, as what they look like.
FIELDS = {
    "num_oferentes_unicos": ("Oferentes únicos", "int"),
    "modalidad_norm": ("Modalidad", "text"),
    "num_invitados": ("Proveedores invitados", "int"),
    "num_respuestas": ("Respuestas recibidas", "int"),
    "id_del_proceso": ("ID del proceso (SECOP)", "text"),
    "fecha_matricula": ("Fecha de matrícula (RUES)", "date"),
    "fecha_publicacion": ("Fecha de publicación del proceso", "date"),
    "dias_desde_matricula": ("Días entre matrícula y publicación", "int"),
    "dias_antes_publicacion": ("Días entre matrícula y publicación", "int"),
    "source": ("Fuente del contrato", "text"),
    "dias_adicionados": ("Días adicionados", "int"),
    "duracion_dias_inicial": ("Duración inicial (días)", "int"),
    "f03_tiempo": ("¿Se activó por plazo adicionado?", "bool"),
    "ratio_adicion_dinero": ("Adición en valor sobre el inicial", "ratio"),
    "f03_dinero": ("¿Se activó por adición en valor?", "bool"),
    "fuente_dinero": ("Fuente de la adición en valor", "text"),
    "nombre_entidad": ("Entidad", "text"),
    "cod_dpto": ("Departamento (código DIVIPOLA)", "text"),
    "share_directa": ("Participación de la entidad en contratación directa", "ratio"),
    "mean_share_peers": ("Promedio del grupo de pares", "ratio"),
    "sd_share_peers": ("Desviación estándar del grupo de pares", "ratio"),
    "n_peers": ("Entidades pares comparadas", "int"),
    "z_score": ("Desviaciones estándar sobre el grupo de pares", "number"),
    "nit_entidad_norm": ("NIT de la entidad", "text"),
    "doc_proveedor_norm": ("Documento del proveedor", "text"),
    "unspsc_segmento": ("Segmento UNSPSC", "text"),
    "n_contratos_ventana": ("Contratos en la ventana de 90 días", "int"),
    "suma_valor_ventana": ("Valor sumado en la ventana", "money"),
    "umbral_smmlv_cop": ("Umbral (280 SMMLV en COP)", "money"),
    "bucket_24m": ("Ventana de 24 meses", "text"),
    "n_procesos_grupo": ("Procesos competitivos en el grupo", "int"),
    "n_ganadores_distintos": ("Ganadores distintos", "int"),
    "participacion_minima_ganador": ("Participación mínima de un ganador", "ratio"),
    "indice_alternancia": ("Índice de alternancia", "ratio"),
    "fecha_recepcion_respuestas": ("Cierre de recepción de ofertas", "date"),
    "dias_ventana": ("Días entre publicación y cierre", "int"),
    "piso_dias": ("Mínimo reglamentario (días)", "int"),
    "valor_contrato": ("Valor del contrato", "money"),
    "precio_base": ("Precio base publicado", "money"),
    "desviacion_pct": ("Desviación frente al precio base", "ratio"),
    "fecha_firma": ("Fecha de firma", "date"),
    "window_id": ("Ventana electoral", "text"),
    "tipo_ventana": ("Tipo de ventana", "text"),
    "descripcion_ventana": ("Descripción de la ventana", "text"),
    "n_sanciones_antes_firma": ("Sanciones antes de la firma", "int"),
    "n_sanciones_total_contexto": ("Sanciones totales (cualquier fecha, contexto)", "int"),
    "fuentes_antes_firma": ("Fuente(s) de la sanción", "list"),
    "fuentes_total_contexto": ("Fuente(s), contexto completo", "list"),
    "sancion_mas_reciente_antes_firma": ("Sanción más reciente antes de la firma", "date"),
    "anio": ("Año", "int"),
    "doc_proveedor_dominante": ("Proveedor dominante (documento)", "text"),
    "n_contratos_entidad_anual": ("Contratos de la entidad ese año", "int"),
    "participacion_proveedor_en_entidad": ("Participación del proveedor en la entidad", "ratio"),
    "condicion_a_captura_entidad": ("¿Un proveedor captura más del 50% del valor?", "bool"),
    "n_contratos_proveedor_anual": ("Contratos del proveedor ese año", "int"),
    "dependencia_proveedor_en_entidad": ("Dependencia del proveedor en esta entidad", "ratio"),
    "condicion_b_dependencia_proveedor": ("¿El proveedor depende en más del 80% de esta entidad?", "bool"),
    "longitud_objeto": ("Longitud del objeto contractual (caracteres)", "int"),
    "objeto_len": ("Longitud del objeto contractual (caracteres)", "int"),
    "frecuencia_objeto": ("Veces que se repite este objeto", "int"),
    "umbral_decil_superior": ("Umbral del decil superior de frecuencia", "number"),
    "objeto_muy_corto": ("¿Objeto muy corto (menos de 40 caracteres)?", "bool"),
    "objeto_repetitivo": ("¿Objeto repetitivo?", "bool"),
    "nota": ("Nota", "text"),
}

FIRED = "array<struct<flag_id:string,nombre:string,peso:int,evidence:string>>"


def as_json(*columns: str | Column) -> Column:
    """One JSON object of the columns, nulls kept."""
    return object_json(F.struct(*columns))


def object_json(structure: Column) -> Column:
    """The JSON object of a structure, nulls kept; null for null."""
    return F.to_json(structure, {"ignoreNullFields": "false"})


def fired_list(found: Mapping[str, tuple[Column, Column]], p: Params) -> Column:
    """JSON array of (flag_id, nombre, peso, evidence), in the order of the ids. found: for each flag whether it fired, and its evidence."""
    items = []
    for k in sorted(found):
        fired, evidence = found[k]
        name, _, weight = p.weights[k]
        items.append(F.when(fired, F.struct(F.lit(k).alias("flag_id"), F.lit(name).alias("nombre"), F.lit(int(weight)).alias("peso"), evidence.alias("evidence"))))
    return F.to_json(F.array_compact(F.array(*items)))


def parsed(text: Column) -> Column:
    """The array in a JSON text; null, empty and broken texts give an empty array."""
    return F.coalesce(F.from_json(text, FIRED), F.array().cast(FIRED))


def as_objects(flags: Column) -> Column:
    """A list of flags as `parsed` gives it, each evidence an object in place of its text; one that is no JSON object is an empty one.

    Objects can't be ordered or compared, so this comes last, where the list is written.
    """
    empty = F.parse_json(F.lit("{}"))
    own = lambda text: F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.try_parse_json(text)).otherwise(empty)
    return F.transform(flags, lambda f: f.withField("evidence", own(f["evidence"])))


def _literal(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def label(key: Column) -> Column:
    spaced = F.trim(F.replace(key, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(_literal({k: n for k, (n, _) in FIELDS.items()}), key), F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30)))


def shown(key: Column, value: Column) -> Column:
    """A value, as text, in the form of its key's kind; what does not fit the kind stays as it is, and nothing is a dash."""
    kind = F.try_element_at(_literal({k: of for k, (_, of) in FIELDS.items()}), key)
    number = F.when(value.rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), value.try_cast("double"))
    truth = F.when(value == "true", F.lit("Sí")).when(value == "false", F.lit("No"))
    as_list = F.array_join(F.from_json(value, "array<string>"), ", ")
    forms = {"money": pesos(number), "ratio": percent(number * 100), "int": decimals(number, 0), "number": decimals(number, 2), "date": spanish_date(value), "bool": truth, "list": as_list, "text": value}
    own = F.coalesce(truth, decimals(number, 2), value)
    for name, form in forms.items():
        own = F.when(kind == name, F.coalesce(form, value)).otherwise(own)
    return F.when(value.isNull() | (value == ""), F.lit("—")).otherwise(own)


def described(evidence_json: Column) -> Column:
    """Array of (key, label, value) of an evidence object, in its order; null and broken texts give null."""
    entries = F.map_entries(F.from_json(evidence_json, "map<string,string>"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), label(e["key"]).alias("label"), shown(e["key"], e["value"]).alias("value")))
