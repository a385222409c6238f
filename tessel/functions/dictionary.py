"""Tag and GeoKey dictionaries of the TIFF and GeoTIFF formats, field types and named constants."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession


class FieldType(IntEnum):
    BYTE = 1
    ASCII = 2
    SHORT = 3
    LONG = 4
    RATIONAL = 5
    SBYTE = 6
    UNDEFINED = 7
    SSHORT = 8
    SLONG = 9
    SRATIONAL = 10
    FLOAT = 11
    DOUBLE = 12
    IFD = 13
    LONG8 = 16
    SLONG8 = 17
    IFD8 = 18


class Photometric(IntEnum):
    WHITE_IS_ZERO = 0
    BLACK_IS_ZERO = 1
    RGB = 2
    PALETTE = 3
    TRANSPARENCY_MASK = 4
    CMYK = 5
    Y_CB_CR = 6
    CIE_LAB = 8
    ICC_LAB = 9


class ExtraSamples(IntEnum):
    UNSPECIFIED = 0
    ASSOCIATED_ALPHA = 1
    UNASSOCIATED_ALPHA = 2


class LercParameters(IntEnum):
    VERSION = 0
    ADD_COMPRESSION = 1


class LercCompression(IntEnum):
    NONE = 0
    DEFLATE = 1
    ZSTANDARD = 2


#: Bytes of a value by field type.
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}

# Tag, name, field type (or None), whether it's an array, whether it's read at once.
TAGS = [
    (254, "NewSubfileType", "LONG", False, True),
    (255, "SubfileType", "SHORT", False, True),
    (256, "ImageWidth", "SHORT", False, True),
    (257, "ImageLength", "SHORT", False, True),
    (258, "BitsPerSample", "SHORT", True, True),
    (259, "Compression", "SHORT", False, True),
    (262, "PhotometricInterpretation", "SHORT", False, True),
    (263, "Threshholding", "SHORT", False, False),
    (264, "CellWidth", "SHORT", False, False),
    (265, "CellLength", "SHORT", False, False),
    (266, "FillOrder", "SHORT", False, False),
    (269, "DocumentName", "ASCII", False, False),
    (270, "ImageDescription", "ASCII", False, False),
    (271, "Make", "ASCII", False, False),
    (272, "Model", "ASCII", False, False),
    (273, "StripOffsets", "SHORT", True, False),
    (274, "Orientation", "SHORT", False, False),
    (277, "SamplesPerPixel", "SHORT", False, True),
    (278, "RowsPerStrip", "SHORT", False, True),
    (279, "StripByteCounts", "LONG", True, False),
    (280, "MinSampleValue", "SHORT", True, False),
    (281, "MaxSampleValue", "SHORT", True, False),
    (282, "XResolution", "RATIONAL", False, False),
    (283, "YResolution", "RATIONAL", False, False),
    (284, "PlanarConfiguration", "SHORT", False, True),
    (285, "PageName", "ASCII", False, False),
    (286, "XPosition", "RATIONAL", False, False),
    (287, "YPosition", "RATIONAL", False, False),
    (288, "FreeOffsets", "LONG", False, False),
    (289, "FreeByteCounts", "LONG", False, False),
    (290, "GrayResponseUnit", "SHORT", False, False),
    (291, "GrayResponseCurve", "SHORT", True, False),
    (292, "T4Options", "LONG", False, False),
    (293, "T6Options", "LONG", False, False),
    (296, "ResolutionUnit", "SHORT", False, False),
    (297, "PageNumber", "SHORT", True, False),
    (301, "TransferFunction", "SHORT", True, False),
    (305, "Software", "ASCII", False, False),
    (306, "DateTime", "ASCII", False, False),
    (315, "Artist", "ASCII", False, False),
    (316, "HostComputer", "ASCII", False, False),
    (317, "Predictor", "SHORT", False, False),
    (318, "WhitePoint", "RATIONAL", True, False),
    (319, "PrimaryChromaticities", "RATIONAL", True, False),
    (320, "ColorMap", "SHORT", True, False),
    (321, "HalftoneHints", "SHORT", True, False),
    (322, "TileWidth", "SHORT", False, True),
    (323, "TileLength", "SHORT", False, True),
    (324, "TileOffsets", "LONG", True, False),
    (325, "TileByteCounts", "SHORT", True, False),
    (332, "InkSet", "SHORT", False, False),
    (333, "InkNames", "ASCII", False, False),
    (334, "NumberOfInks", "SHORT", False, False),
    (336, "DotRange", "BYTE", True, False),
    (337, "TargetPrinter", "ASCII", False, False),
    (338, "ExtraSamples", "BYTE", True, True),
    (339, "SampleFormat", "SHORT", True, True),
    (340, "SMinSampleValue", None, True, False),
    (341, "SMaxSampleValue", None, True, False),
    (342, "TransferRange", "SHORT", True, False),
    (512, "JPEGProc", "SHORT", False, False),
    (513, "JPEGInterchangeFormat", "LONG", False, False),
    (514, "JPEGInterchangeFormatLngth", "LONG", False, False),
    (515, "JPEGRestartInterval", "SHORT", False, False),
    (517, "JPEGLosslessPredictors", "SHORT", True, False),
    (518, "JPEGPointTransforms", "SHORT", True, False),
    (519, "JPEGQTables", "LONG", True, False),
    (520, "JPEGDCTables", "LONG", True, False),
    (521, "JPEGACTables", "LONG", True, False),
    (529, "YCbCrCoefficients", "RATIONAL", True, False),
    (530, "YCbCrSubSampling", "SHORT", True, False),
    (531, "YCbCrPositioning", "SHORT", False, False),
    (532, "ReferenceBlackWhite", "LONG", True, False),
    (33432, "Copyright", "ASCII", False, False),
    (326, "BadFaxLines", None, False, False),
    (327, "CleanFaxData", None, False, False),
    (343, "ClipPath", None, False, False),
    (328, "ConsecutiveBadFaxLines", None, False, False),
    (433, "Decode", None, False, False),
    (434, "DefaultImageColor", None, False, False),
    (346, "Indexed", None, False, False),
    (347, "JPEGTables", None, True, True),
    (559, "StripRowCounts", None, True, False),
    (330, "SubIFDs", None, True, False),
    (344, "XClipPathUnits", None, False, False),
    (345, "YClipPathUnits", None, False, False),
    (37378, "ApertureValue", None, False, False),
    (40961, "ColorSpace", None, False, False),
    (36868, "DateTimeDigitized", None, False, False),
    (36867, "DateTimeOriginal", None, False, False),
    (34665, "Exif IFD", "LONG", False, False),
    (36864, "ExifVersion", None, False, False),
    (33434, "ExposureTime", None, False, False),
    (41728, "FileSource", None, False, False),
    (37385, "Flash", None, False, False),
    (40960, "FlashpixVersion", None, False, False),
    (33437, "FNumber", None, False, False),
    (42016, "ImageUniqueID", None, False, False),
    (37384, "LightSource", None, False, False),
    (37500, "MakerNote", None, False, False),
    (37377, "ShutterSpeedValue", None, False, False),
    (37510, "UserComment", None, False, False),
    (33723, "IPTC", None, False, False),
    (34412, "CZ_LSMINFO", None, False, False),
    (34675, "ICC Profile", None, False, False),
    (700, "XMP", None, False, False),
    (42112, "GDAL_METADATA", None, False, False),
    (42113, "GDAL_NODATA", "ASCII", False, True),
    (34377, "Photoshop", None, False, False),
    (33550, "ModelPixelScale", "DOUBLE", True, True),
    (33922, "ModelTiepoint", "DOUBLE", True, True),
    (34264, "ModelTransformation", "DOUBLE", True, True),
    (34735, "GeoKeyDirectory", "SHORT", True, True),
    (34736, "GeoDoubleParams", "DOUBLE", True, True),
    (34737, "GeoAsciiParams", "ASCII", False, True),
    (50674, "LercParameters", None, False, True),
]

# GeoKeys.
GEO_KEYS = {
    1024: "GTModelTypeGeoKey",
    1025: "GTRasterTypeGeoKey",
    1026: "GTCitationGeoKey",
    2048: "GeographicTypeGeoKey",
    2049: "GeogCitationGeoKey",
    2050: "GeogGeodeticDatumGeoKey",
    2051: "GeogPrimeMeridianGeoKey",
    2052: "GeogLinearUnitsGeoKey",
    2053: "GeogLinearUnitSizeGeoKey",
    2054: "GeogAngularUnitsGeoKey",
    2055: "GeogAngularUnitSizeGeoKey",
    2056: "GeogEllipsoidGeoKey",
    2057: "GeogSemiMajorAxisGeoKey",
    2058: "GeogSemiMinorAxisGeoKey",
    2059: "GeogInvFlatteningGeoKey",
    2060: "GeogAzimuthUnitsGeoKey",
    2061: "GeogPrimeMeridianLongGeoKey",
    2062: "GeogTOWGS84GeoKey",
    3072: "ProjectedCSTypeGeoKey",
    3073: "PCSCitationGeoKey",
    3074: "ProjectionGeoKey",
    3075: "ProjCoordTransGeoKey",
    3076: "ProjLinearUnitsGeoKey",
    3077: "ProjLinearUnitSizeGeoKey",
    3078: "ProjStdParallel1GeoKey",
    3079: "ProjStdParallel2GeoKey",
    3080: "ProjNatOriginLongGeoKey",
    3081: "ProjNatOriginLatGeoKey",
    3082: "ProjFalseEastingGeoKey",
    3083: "ProjFalseNorthingGeoKey",
    3084: "ProjFalseOriginLongGeoKey",
    3085: "ProjFalseOriginLatGeoKey",
    3086: "ProjFalseOriginEastingGeoKey",
    3087: "ProjFalseOriginNorthingGeoKey",
    3088: "ProjCenterLongGeoKey",
    3089: "ProjCenterLatGeoKey",
    3090: "ProjCenterEastingGeoKey",
    3091: "ProjCenterNorthingGeoKey",
    3092: "ProjScaleAtNatOriginGeoKey",
    3093: "ProjScaleAtCenterGeoKey",
    3094: "ProjAzimuthAngleGeoKey",
    3095: "ProjStraightVertPoleLongGeoKey",
    3096: "ProjRectifiedGridAngleGeoKey",
    4096: "VerticalCSTypeGeoKey",
    4097: "VerticalCitationGeoKey",
    4098: "VerticalDatumGeoKey",
    4099: "VerticalUnitsGeoKey",
}

# The field types that the writer gives to tags.
WRITER_TYPES = {
    "SHORT": [256, 257, 258, 259, 262, 274, 277, 284, 286, 296, 297, 322, 323, 338, 339, 1024, 1025, 2052, 2054, 2060, 3072, 3076, 4096, 4099, 34735],
    "LONG": [273, 278, 279, 324, 325, 513, 514, 34665],
    "RATIONAL": [282, 283, 287],
    "ASCII": [270, 271, 272, 305, 306, 315, 33432, 34737, 42113],
    "DOUBLE": [33550, 33922, 34264, 34736],
}
#: Further tags with a type, that the writer has no place for.
OTHER_TYPES = {"SHORT": [2048], "ASCII": [1026, 2049, 3073, 4097], "DOUBLE": [2057, 2059]}

_names: dict[str, int] = {name: tag for tag, name, *_ in TAGS}
_defined: dict[int, tuple[int, str, str | None, bool, bool]] = {row[0]: row for row in TAGS}
_geo_names = {name: key for key, name in GEO_KEYS.items()}


def register_tag(tag: int, name: str, field_type: str | None = None, is_array: bool = False, eager: bool = False) -> None:
    """Adds or replaces a tag of the dictionary; names that it had before still lead to it."""
    _names[name] = tag
    _defined[tag] = (tag, name, field_type, is_array, eager)


def resolve_tag(tag: int | str) -> int:
    if isinstance(tag, int):
        return tag
    if tag not in _names:
        raise KeyError(f"Unknown tag name: {tag}")
    return _names[tag]


def get_tag(tag: int | str) -> tuple[int, str, str | None, bool, bool] | None:
    return _defined.get(_names.get(tag, -1) if isinstance(tag, str) else tag)


def tags() -> dict[str, int]:
    return dict(_names)


def tag_definitions() -> dict[int, tuple[int, str, str | None, bool, bool]]:
    return dict(_defined)


def tag_name(tag: int) -> str:
    return _defined[tag][1] if tag in _defined else f"Tag{tag}"


def field_tag_type(tag: int) -> str | None:
    return next((kind for table in (WRITER_TYPES, OTHER_TYPES) for kind, ids in table.items() if tag in ids), None)


def writer_type(tag: int) -> str | None:
    return next((kind for kind, ids in WRITER_TYPES.items() if tag in ids), None)


def get_field_type_size(field_type: int) -> int:
    if field_type not in FIELD_SIZES:
        raise ValueError(f"Invalid field type: {field_type}")
    return FIELD_SIZES[field_type]


def geo_key_name(key: int) -> str | None:
    return GEO_KEYS.get(key)


def geo_key_id(name: str) -> int | None:
    return _geo_names.get(name)


def tag_dictionary(spark: SparkSession) -> DataFrame:
    """The dictionary as a small table, for broadcast joins with tag rows."""
    rows = [(t, n, k, a, e) for t, n, k, a, e in sorted(_defined.values())]
    return spark.createDataFrame(rows, "tag int, name string, field_type string, is_array boolean, eager boolean")


def geo_key_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(GEO_KEYS.items()), "key_id int, name string")
