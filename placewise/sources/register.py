"""Features of the land-register XML as tables, and the links between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.functions.text import href_id

# Features of the register and the attributes used from each.
FEATURES = (
    "RCN_Transakcja", "RCN_Dokument", "RCN_Nieruchomosc", "RCN_Dzialka", "RCN_Budynek", "RCN_Lokal", "RCN_Adres",
)
FEATURE_ATTRIBUTES = {
    "RCN_Transakcja": ("cenaTransakcjiBrutto", "rodzajTransakcji", "rodzajRynku"),
    "RCN_Dokument": ("dataSporzadzeniaDokumentu",),
    "RCN_Nieruchomosc": (),
    "RCN_Dzialka": ("idDzialki",),
    "RCN_Budynek": ("rodzajBudynku",),
    "RCN_Lokal": ("powUzytkowaLokalu", "funkcjaLokalu", "nrKondygnacji", "liczbaIzb", "dodatkoweInformacje"),
    "RCN_Adres": ("ulica", "numerPorzadkowy"),
}
FEATURE_LINKS = {
    "RCN_Transakcja": ("nieruchomosc", "podstawaPrawna"),
    "RCN_Nieruchomosc": ("lokal", "budynek", "dzialka"),
    "RCN_Lokal": ("adres",),
}

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_TEXT = T.StringType()
_LINK = T.ArrayType(_struct(_href=_TEXT))
# Geometry elements of GML, as far as they hold positions.  A list of positions is one text or one text per position.
_LINE = _struct(posList=_struct(_VALUE=_TEXT, _srsDimension=_TEXT), pos=T.ArrayType(_TEXT), _srsDimension=_TEXT)
_SEGMENTS = ("LineStringSegment", "Arc", "ArcString", "GeodesicString")
_CURVE = _struct(segments=_struct(**{s: T.ArrayType(_LINE) for s in _SEGMENTS}))
_CURVES = _struct(LineString=_LINE, Curve=_CURVE)
_RING = _struct(LinearRing=_LINE, Ring=_struct(curveMember=T.ArrayType(_CURVES)))
_POLYGON = _struct(exterior=_RING, interior=T.ArrayType(_RING))
_PATCHES = _struct(PolygonPatch=T.ArrayType(_POLYGON))
_SURFACES = _struct(Polygon=_POLYGON, Surface=_struct(patches=_PATCHES))
_POINT = _struct(pos=_TEXT)
_GEOMETRY = _struct(
    Point=_POINT,
    LineString=_LINE,
    Curve=_CURVE,
    Polygon=_POLYGON,
    Surface=_struct(patches=_PATCHES),
    MultiPoint=_struct(pointMember=T.ArrayType(_struct(Point=_POINT)), pointMembers=_struct(Point=T.ArrayType(_POINT))),
    MultiLineString=_struct(lineStringMember=T.ArrayType(_CURVES)),
    MultiCurve=_struct(curveMember=T.ArrayType(_CURVES), curveMembers=_struct(LineString=T.ArrayType(_LINE), Curve=T.ArrayType(_CURVE))),
    MultiPolygon=_struct(polygonMember=T.ArrayType(_SURFACES)),
    MultiSurface=_struct(
        surfaceMember=T.ArrayType(_SURFACES), surfaceMembers=_struct(Polygon=T.ArrayType(_POLYGON), Surface=T.ArrayType(_struct(patches=_PATCHES)))
    ),
)


# -- what a layer holds ---------------------------------------------------------------


def _outline(text: str) -> object:
    """A schema as ``schema_of_variant_agg`` writes it: dict for OBJECT, one-element list for ARRAY, else the type's name."""
    kind, _, rest = text.partition("<")
    if kind == "ARRAY":
        return [_outline(rest[:-1])]
    if kind != "OBJECT":
        return text
    fields, depth, start, quoted = [], 0, 0, False
    body = rest[:-1]
    for i, c in enumerate(body):
        if c == "`":
            quoted = not quoted
        elif not quoted:
            depth += (c in "<(") - (c in ">)")
            if c == "," and not depth:
                fields.append(body[start:i])
                start = i + 1
    out = {}
    for field in [*fields, body[start:]]:
        if field.strip():
            name, _, of = field.strip().rpartition(": ") if field.strip().startswith("`") and "<" not in field else field.strip().partition(": ")
            out[name.strip("`")] = _outline(of)
    return out


def _attribute(found: object, plain: bool = False, repeated: bool = False) -> T.DataType:
    """The type to read a child element with: text wherever the element has no children.

    ``found`` is the outline of the elements that have children or attributes
    (else a type's name), ``plain`` tells of others without, ``repeated`` of a
    parent with several.
    """
    if isinstance(found, list):
        return _attribute(found[0], repeated=True)
    if isinstance(found, dict) and "_href" in found:
        return _LINK
    kinds = set(found) & set(_GEOMETRY.names) if isinstance(found, dict) else set()
    if kinds:
        return T.StructType([f for f in _GEOMETRY.fields if f.name in kinds])
    # A VARIANT was seen in several forms; as a list of texts every one of them can be read.
    if repeated or found == "VARIANT":
        return T.ArrayType(_TEXT)
    if not isinstance(found, dict):
        return _TEXT
    inner = {n: _attribute(t) for n, t in found.items()}
    return _struct(**({"_VALUE": _TEXT} if plain else {}) | inner)


def _found_schemas(rows: DataFrame) -> dict[str, T.StructType]:
    """Schema per feature of ``rows`` (feature, v): members as variants.

    One row per child element; outlines merge in the tasks first and then between
    them, and one short row per feature and tag reaches the driver.
    """
    of = F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("tag", "value")
    kind = F.schema_of_variant("value")
    each = rows.select("feature", of).withColumn("kind", kind)
    several = each.where("kind LIKE 'ARRAY%'").select("feature", "tag", F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("value"))
    every = each.select("*", F.lit(False).alias("repeated")).where("kind NOT LIKE 'ARRAY%'").unionByName(
        several.withColumn("kind", kind).withColumn("repeated", F.lit(True))
    )
    nested = F.col("kind").startswith("OBJECT")
    merged = F.schema_of_variant_agg("value").alias("outline")
    seen = every.groupBy("feature", "tag", nested.alias("nested")).agg(merged, F.max("repeated").alias("repeated"))
    tags = seen.groupBy("feature", "tag").agg(
        F.max(F.when(F.col("nested"), F.col("outline"))).alias("outline"), F.max(~F.col("nested")).alias("plain"), F.max("repeated").alias("repeated")
    )
    found: dict[str, dict[str, T.DataType]] = {}
    for r in tags.orderBy("feature", "tag").collect():
        # Attributes of the member's own tag are its id and namespaces.
        if not r["tag"].startswith("_"):
            outline = _outline(r["outline"]) if r["outline"] else None
            found.setdefault(r["feature"], {})[r["tag"]] = _attribute(outline if isinstance(outline, dict) else None, r["plain"], r["repeated"])
    return {feature: _with_known(feature, of) for feature, of in found.items()}


def _with_known(feature: str, found: dict[str, T.DataType]) -> T.StructType:
    """What the library itself reads of a feature, then all else that was found."""
    known = feature_schema(feature) if feature in FEATURE_ATTRIBUTES else _struct(_id=_TEXT)
    fields = {f.name: f.dataType for f in known.fields}
    if any(_is_geometry(t) for t in found.values()):
        fields.pop("geometria", None)
    return _struct(**fields | {n: t for n, t in found.items() if n not in fields or fields[n] != _LINK})


def feature_schema(feature: str, attributes: Sequence[str] | None = None, links: Sequence[str] | None = None) -> T.StructType:
    """Declared schema of one feature: id, text attributes, links, geometry."""
    attributes = FEATURE_ATTRIBUTES[feature] if attributes is None else attributes
    links = FEATURE_LINKS.get(feature, ()) if links is None else links
    return _struct(_id=_TEXT, **dict.fromkeys(attributes, _TEXT), **dict.fromkeys(links, _LINK), geometria=_attribute({"Point": "", "Polygon": ""}))


def _is_geometry(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and bool(kind.names) and set(kind.names) <= set(_GEOMETRY.names)


_MEMBER = r"(?s)<(?:\w+:)?(RCN_\w+)(?:\s[^<>]*/>|[\s>].*</(?:\w+:)?\1>|/>)"
_NAME = r"^<(?:\w+:)?(RCN_\w+)"


def split_members(spark: SparkSession, path: str, member_end: str) -> DataFrame:
    """(feature, xml) of every member of a register file, read in parallel splits.

    ``member_end`` is the closing tag of the element each feature is wrapped
    in, such as ``</gml:featureMember>``.
    """
    value = F.col("value")
    before, last = F.substring_index(value, "RCN_", 1), F.substring_index(value, "<", -1)
    cut = spark.read.text(path, lineSep=member_end).select("value", before.alias("before"), last.alias("last"))
    cut = cut.withColumns({"prefix": F.substring_index("before", "<", -1), "close": F.rtrim("last", F.lit(" \t\r\n"))})
    # Places are counted in bytes, which are known; characters would be counted through the whole member.
    size = F.octet_length
    start = size("before") - size("prefix")
    whole = F.substring(F.col("value").cast("binary"), start, size("value") - start + 1 - size("last") + size("close"))
    cut = cut.select("value", "prefix", "close", whole.cast("string").alias("whole")).withColumn("open", F.substring_index("whole", ">", 1))
    # What follows the first space of the tag says nothing of its name.
    cut = cut.withColumn("name", F.regexp_extract(F.substring_index("open", " ", 1), _NAME + r"(?=\s|$)", 1))
    # Most members end with the tag they start with and are cut at known places; the pattern, which gives the same, reads every character.
    plain = (F.col("name") != "") & ~F.endswith("open", F.lit("/")) & (F.col("close") == F.concat(F.lit("/"), "prefix", "name", F.lit(">")))
    xml = F.when(plain, F.col("whole")).otherwise(F.regexp_extract("value", _MEMBER, 0))
    # As a generated row a member is cut out once; a plain column would be again for each filter and column made of it.
    found = cut.select(F.explode(F.array(F.struct(F.when(plain, F.col("name")).alias("feature"), xml.alias("xml")))).alias("m"))
    return found.where(F.col("m.xml") != "").select(F.coalesce("m.feature", F.regexp_extract("m.xml", _NAME, 1)).alias("feature"), "m.xml")


def member_schemas(members: DataFrame) -> dict[str, T.StructType]:
    """Schema of every feature class in ``split_members`` rows, from the data, in one pass.

    Members are reduced to their bare structure, texts and values all alike, of
    which there are few kinds: tasks pass on each kind once, and only those are
    parsed.
    """
    bare = F.regexp_replace("xml", r"([>=])(?:(?<=>)\s*+[^<>\s][^<>]*+(?=<)|(?<==)\s*+(?:\"[^\"]*+\"|'[^']*+'))", '$1"x"')
    kinds = members.groupBy("feature", bare.alias("xml")).agg(F.count("*").alias("n"))
    # The row tag only names the outermost element of each text.
    read = F.from_xml("xml", "v variant", {"rowTag": "member", "ignoreNamespace": "true", "singleVariantColumn": "v"})
    return _found_schemas(kinds.select("feature", read["v"].alias("v")))


def parse_members(members: DataFrame, feature: str, schema: T.StructType | None = None) -> DataFrame:
    """One feature class of ``split_members`` rows, as ``read_features`` gives it."""
    own = members.where(F.col("feature") == feature)
    schema = schema or member_schemas(own).get(feature) or _with_known(feature, {})
    parsed = F.from_xml("xml", schema, {"rowTag": feature, "ignoreNamespace": "true"})
    return _as_table(own.select(parsed.alias("f")).select("f.*"), schema)


def _links_only(schema: T.StructType) -> list[T.StructField]:
    """The fields of links, those of nested elements too."""
    kept = []
    for f in schema.fields:
        if f.dataType == _LINK:
            kept.append(f)
        elif isinstance(f.dataType, T.StructType) and not _is_geometry(f.dataType) and (inner := _links_only(f.dataType)):
            kept.append(T.StructField(f.name, T.StructType(inner)))
    return kept


def parse_links(members: DataFrame, feature: str) -> DataFrame:
    """gml_id and link arrays of one feature class: those columns of ``parse_members``, and no others are read."""
    own = members.where(F.col("feature") == feature)
    schema = member_schemas(own).get(feature) or _with_known(feature, {})
    return parse_members(own, feature, T.StructType([T.StructField("_id", _TEXT), *_links_only(schema)])).drop("geometry_wkt")


def read_features(
    spark: SparkSession,
    path: str,
    feature: str,
    schema: T.StructType | None = None,
    member_end: str | None = None,
) -> DataFrame:
    """One feature class as gml_id, attributes, link arrays and geometry_wkt.

    Without a ``schema`` the columns come from the data: every child element of
    the feature that any member has.  Attributes are text; a nested element gives
    a column per leaf (``outer_inner``), one with attributes of its own also those
    (``name_uom``), a repeated one its texts joined by commas.  Geometry elements
    become WKT of their first two dimensions, the first one as ``geometry_wkt``,
    others as ``<element>_wkt``; arcs are given by their positions.

    Whole XML documents are streamed, one task per file; with ``member_end``
    Spark splits a large file between its members instead.
    """
    if member_end:
        return parse_members(split_members(spark, path, member_end), feature, schema)
    reader = spark.read.format("xml").option("rowTag", feature).option("ignoreNamespace", True)
    if schema is None:
        whole = spark.read.format("xml").option("rowTag", feature).option("ignoreNamespace", True).option("singleVariantColumn", "v")
        schema = _found_schemas(whole.load(path).select(F.lit(feature).alias("feature"), "v")).get(feature) or _with_known(feature, {})
    return _as_table(reader.schema(schema).load(path), schema)


# -- geometry as text -----------------------------------------------------------------


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``; the value is stated once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def _two(numbers: Column, at: Column | int = 0) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.concat(F.get(numbers, at), F.lit(" "), F.get(numbers, at + 1))


def _numbers(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _positions(line: Column) -> Column:
    """The positions of a line as texts ``x y``; an empty array without a whole one."""
    dims = F.coalesce(line["posList"]["_srsDimension"].try_cast("int"), line["_srsDimension"].try_cast("int"), F.lit(2))

    def listed(n: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(n) - dims, F.lit(0)), dims)
        return F.when(F.size(n) >= dims, F.transform(starts, lambda i: _two(n, i)))

    single = F.transform(line["pos"], lambda p: _two(_numbers(p)))
    return F.coalesce(_let(_numbers(line["posList"]["_VALUE"]), listed), single, F.array().cast("array<string>"))


def _joined(lines: Column) -> Column:
    """Positions of lines that follow each other; where one starts with the end of the last, it is kept once."""
    return _let(F.flatten(lines), lambda points: F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1))))


def _segments(curve: Column) -> Column:
    return _joined(F.transform(_every(_LINE, *[curve["segments"][s] for s in _SEGMENTS]), _positions))


def _curve(member: Column) -> Column:
    return _let(_positions(member["LineString"]), lambda straight: F.when(F.size(straight) > 0, straight).otherwise(_segments(member["Curve"])))


def _bracketed(points: Column) -> Column:
    return _let(points, lambda p: F.when(F.size(p) > 0, F.concat(F.lit("("), F.array_join(p, ", "), F.lit(")"))))


def _ring(ring: Column) -> Column:
    curved = _joined(F.transform(_every(_CURVES, ring["Ring"]["curveMember"]), _curve))
    return _bracketed(_let(_positions(ring["LinearRing"]), lambda plain: F.when(F.size(plain) > 0, plain).otherwise(curved)))


def _listed(parts: Column) -> Column:
    """Texts in brackets, NULL ones left out; NULL without any."""
    return _bracketed(F.filter(parts, lambda p: p.isNotNull()))


def _polygon(polygon: Column) -> Column:
    holes = F.transform(_every(_RING, polygon["interior"]), _ring)
    return _let(_ring(polygon["exterior"]), lambda outer: F.when(outer.isNotNull(), _listed(F.concat(F.array(outer), holes))))


def _every(kind: T.DataType, *arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, F.array().cast(T.ArrayType(kind))) for a in arrays])


def _patches(surface: Column) -> Column:
    return F.transform(_every(_POLYGON, surface["patches"]["PolygonPatch"]), _polygon)


def _surfaces(member: Column) -> Column:
    return F.concat(F.array(_polygon(member["Polygon"])), _patches(member["Surface"]))


def _point(point: Column) -> Column:
    return _let(_numbers(point["pos"]), lambda n: F.when(F.size(n) >= 2, _two(n)))


def _named(kind: str, text: Column) -> Column:
    return F.concat(F.lit(f"{kind} "), text)


def _in_brackets(text: Column) -> Column:
    return F.concat(F.lit("("), text, F.lit(")"))


def _surface_text(g: Column) -> Column:
    def text(patches: Column) -> Column:
        return F.when(F.size(patches) == 1, _named("POLYGON", F.get(patches, 0))).otherwise(_named("MULTIPOLYGON", _listed(patches)))

    return _let(F.filter(_patches(g), lambda p: p.isNotNull()), text)


def _points_text(g: Column) -> Column:
    single = F.transform(_every(_struct(Point=_POINT), g["pointMember"]), lambda m: _point(m["Point"]))
    return _named("MULTIPOINT", _listed(F.transform(F.concat(single, F.transform(_every(_POINT, g["pointMembers"]["Point"]), _point)), _in_brackets)))


def _curves_text(g: Column) -> Column:
    lines = [F.transform(_every(_CURVES, g["curveMember"]), lambda m: _bracketed(_curve(m))),
             F.transform(_every(_LINE, g["curveMembers"]["LineString"]), lambda m: _bracketed(_positions(m))),
             F.transform(_every(_CURVE, g["curveMembers"]["Curve"]), lambda m: _bracketed(_segments(m)))]
    return _named("MULTILINESTRING", _listed(F.concat(*lines)))


def _surfaces_text(g: Column) -> Column:
    faces = [F.flatten(F.transform(_every(_SURFACES, g["surfaceMember"]), _surfaces)),
             F.transform(_every(_POLYGON, g["surfaceMembers"]["Polygon"]), _polygon),
             F.flatten(F.transform(_every(_struct(patches=_PATCHES), g["surfaceMembers"]["Surface"]), _patches))]
    return _named("MULTIPOLYGON", _listed(F.concat(*faces)))


_TEXT_OF = {
    "Point": lambda g: _named("POINT", _in_brackets(_point(g))),
    "LineString": lambda g: _named("LINESTRING", _bracketed(_positions(g))),
    "Curve": lambda g: _named("LINESTRING", _bracketed(_segments(g))),
    "Polygon": lambda g: _named("POLYGON", _polygon(g)),
    "Surface": _surface_text,
    "MultiPoint": _points_text,
    "MultiLineString": lambda g: _named("MULTILINESTRING", _listed(F.transform(_every(_CURVES, g["lineStringMember"]), lambda m: _bracketed(_curve(m))))),
    "MultiCurve": _curves_text,
    "MultiPolygon": lambda g: _named("MULTIPOLYGON", _listed(F.flatten(F.transform(_every(_SURFACES, g["polygonMember"]), _surfaces)))),
    "MultiSurface": _surfaces_text,
}


def _wkt(value: Column, kind: T.StructType) -> Column:
    """Whichever geometry the element holds, of those its type names, as WKT."""
    # Without the element its text is NULL, but would be worked out ring by ring.
    return F.coalesce(F.lit(None).cast("string"), *[F.when(value[k].isNotNull(), _TEXT_OF[k](value[k])) for k in kind.names])


def _columns(name: str, value: Column, kind: T.DataType) -> list[Column]:
    """The output columns of one child element."""
    if kind == _LINK:
        return [value.alias(name)]
    if isinstance(kind, T.ArrayType):
        return [F.array_join(value, ",").alias(name)]
    if _is_geometry(kind):
        return [_wkt(value, kind).alias(f"{name}_wkt")]
    if isinstance(kind, T.StructType):
        inner = lambda n: name if n == "_VALUE" else f"{name}_{n.lstrip('_')}"
        return [c for f in kind.fields for c in _columns(inner(f.name), value[f.name], f.dataType)]
    return [value.alias(name)]


def _as_table(raw: DataFrame, schema: T.StructType) -> DataFrame:
    places = {f.name: f.dataType for f in schema.fields if _is_geometry(f.dataType)}
    main = "geometria" if "geometria" in places else next(iter(places), None)
    rest = [c for f in schema.fields if f.name not in ("_id", main) for c in _columns(f.name, F.col(f"`{f.name}`"), f.dataType)]
    place = _wkt(F.col(f"`{main}`"), places[main]) if main else F.lit(None).cast("string")
    return raw.select(F.col("_id").alias("gml_id"), *rest, place.alias("geometry_wkt"))


def _links(features: DataFrame, word: str, whole: bool = False) -> Column:
    """The links of all columns whose tag holds ``word`` (or is it, if ``whole``)."""
    kinds = dict(features.dtypes)
    tags = [c for c, kind in kinds.items() if kind.startswith("array") and (c == word if whole else word in c)]
    return F.flatten(F.array(*[F.coalesce(F.col(t), F.array().cast(kinds[t])) for t in tags]))


def _hrefs(features: DataFrame, word: str, whole: bool = False) -> Column:
    """Targets of these links."""
    return F.filter(F.transform(_links(features, word, whole), lambda c: href_id(c["_href"])), lambda h: h.isNotNull() & (h != ""))


def _each(features: DataFrame, word: str, parent: str, child: str) -> DataFrame:
    links = features.select(F.col("gml_id").alias(parent), F.explode(_links(features, word)).alias("_link"))
    return links.select(parent, href_id(F.col("_link._href")).alias(child)).where(F.col(child) != "")


def _last(features: DataFrame, word: str, parent: str, child: str, whole: bool = False) -> DataFrame:
    last = F.try_element_at(_hrefs(features, word, whole), F.lit(-1))
    found = features.select(F.col("gml_id").alias(parent), last.alias(child))
    return found.where(F.col(parent).isNotNull() & F.col(child).isNotNull())


def edges_transaction_property(transactions: DataFrame) -> DataFrame:
    return _each(transactions, "nieruchomosc", "id_transakcji", "id_nieruchomosci")


def edges_transaction_document(transactions: DataFrame) -> DataFrame:
    return _last(transactions, "podstawaPrawna", "id_transakcji", "id_dokumentu", whole=True)


def edges_property_premises(properties: DataFrame) -> DataFrame:
    return _each(properties, "lokal", "id_nieruchomosci", "id_lokalu")


def edges_property_building(properties: DataFrame) -> DataFrame:
    return _each(properties, "budynek", "id_nieruchomosci", "id_budynku")


def edges_property_parcel(properties: DataFrame) -> DataFrame:
    return _each(properties, "dzialka", "id_nieruchomosci", "id_dzialki")


def edges_premises_address(premises: DataFrame) -> DataFrame:
    return _last(premises, "adres", "id_lokalu", "id_adresu")
