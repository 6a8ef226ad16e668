"""JSON text as whole values."""

from pyspark.sql import functions as F


def whole_json(col, fail=False):
    """The variant of a text that is exactly one JSON value, else NULL (or an error).

    The parser stops after the first value, so trailing text would pass. A text is
    one whole value only if it parses both as the sole element of an array and as
    the sole field of an object: extra text can close one of the two, not both.
    """
    parse = F.parse_json if fail else F.try_parse_json
    in_array = F.concat(F.lit("["), col, F.lit("]"))
    in_object = F.concat(F.lit('{"v":'), col, F.lit("}"))
    return F.variant_get(F.when(parse(in_object).isNotNull(), parse(in_array)), "$[0]", "variant")


def is_string(variant):
    return F.schema_of_variant(variant) == "STRING"
