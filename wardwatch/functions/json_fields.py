"""JSON documents as VARIANT: strict parsing and typed field access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardwatch.schema import ENVELOPE_KEYS

_PARSE_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}

# Decimal text of a float: optional sign, digits with single underscores, optional fraction and exponent.
_DIGITS = r"\d+(?:_\d+)*"
_FLOAT_TEXT = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"

# An integer literal too long for 64 bits keeps no integer type inside a variant, but it keeps its spelling as text.
_INTEGER_TEXT = r"^-?[0-9]+\z"

# A number whose parsed value may be spelled otherwise: with a fraction or an exponent, very long, or not finite.
_SPELLED_NUMBER = r'(?:"\s*:|[\[,])\s*-?(?:[0-9]+[.eE]|[0-9]{19}|NaN|Infinity)'


def with_document(rows: DataFrame, text: Column, name: str = "document") -> DataFrame:
    """Adds the VARIANT of ``text`` when the whole text is one JSON object in UTF-8, else NULL.

    The JSON reader stops after the first value, so trailing characters would go unseen. The text is
    therefore read as the first element of a two-element array closed by a hash of the text itself: the
    hash is found in second place only when nothing but the object precedes it. A leading byte order mark is
    skipped. The array is a column of its own, so that it is built once per row.
    """
    seal = F.xxhash64(text)
    unmarked = F.regexp_replace(text, "^\ufeff", "")
    body = F.when(text.startswith("\ufeff"), unmarked).otherwise(text)
    array = F.concat(F.lit("["), body, F.lit(","), seal.cast("string"), F.lit("]"))
    sealed = F.col("_sealed")
    is_object = (
        F.is_valid_utf8(text)
        & F.ltrim(body, F.lit(" \t\r\n")).startswith("{")
        & (F.try_variant_get(sealed, "$[1]", "bigint") == seal)
    )
    return (
        rows.withColumn("_sealed", F.from_json(array, "variant", _PARSE_OPTIONS))
        .withColumn(name, F.when(is_object, F.try_variant_get(sealed, "$[0]", "variant")))
        .drop("_sealed")
    )


def field(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """Type name of a variant: STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, OBJECT<..>, ARRAY<..>."""
    return F.schema_of_variant(value)


def required_text(document: Column, name: str) -> Column:
    """The field as text when it is a non-empty JSON string, else NULL.

    Reading a field as text also turns numbers, flags, and nested values into text. Such text starts with one
    of a few characters, so the type is looked up only when the text starts with one of them.
    """
    text = F.try_variant_get(document, f"$.{name}", "string")
    first = F.substring(text, 1, 1)
    unmistakable = ~first.isin(*"0123456789-tfnNIi{[")
    return F.when((text != "") & (unmistakable | (kind(field(document, name)) == "STRING")), text)


def spellings(text: Column) -> Column:
    """Top-level fields of a JSON object as an array of (key, value) in order, with the text of each value.

    NULL when no number in the text can be spelled otherwise than its value, so that most texts are parsed only once.
    """
    unmarked = F.regexp_replace(text, "^\ufeff", "")
    entries = F.map_entries(F.from_json(unmarked, "map<string,string>", _PARSE_OPTIONS))
    return F.when(text.rlike(_SPELLED_NUMBER), entries)


def spelling(spelled: Column, name: Column) -> Column:
    """The text of a top-level field; of a repeated key the last one, as in the parsed document."""
    return F.try_element_at(F.filter(spelled, lambda e: e["key"] == name), F.lit(-1))["value"]


def seq_is_valid(document: Column, spelled: Column) -> Column:
    """Absent, null, or an integer of any length; a boolean, a float, and a string are not."""
    seq_kind = kind(field(document, "seq"))
    return (
        seq_kind.isNull()
        | seq_kind.isin("VOID", "BIGINT")
        | F.when(
            seq_kind.startswith("DECIMAL") | (seq_kind == "DOUBLE"), F.coalesce(spelling(spelled, F.lit("seq")).rlike(_INTEGER_TEXT), F.lit(False))
        ).otherwise(F.lit(False))
    )


def seq_value(document: Column) -> Column:
    """64-bit value of ``seq``; NULL when absent or longer than 64 bits."""
    return F.when(kind(field(document, "seq")) == "BIGINT", F.try_variant_get(document, "$.seq", "bigint"))


def _quoted(text: Column) -> Column:
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def payload_text(document: Column, spelled: Column) -> Column:
    """V7: every non-envelope key as a JSON object; types, nulls, nested values, and all digits of numbers are kept.

    A repeated key keeps its last value. Keys come in the order of their names. Zeros at the end of a fraction may go,
    but a number with a fraction keeps one.
    """
    entries = document.cast("map<string,variant>")
    names = F.filter(F.map_keys(entries), lambda key: ~key.isin(*ENVELOPE_KEYS))

    def member(name: Column) -> Column:
        value = spelling(spelled, name)
        value_kind = kind(F.try_element_at(entries, name))
        # NaN and Infinity come quoted from the reader, but are no strings.
        bare = F.when(value_kind == "DOUBLE", F.regexp_replace(value, '^"|"$', "")).otherwise(value)
        return F.concat(
            _quoted(name), F.lit(":"), F.when(value.isNull(), "null").when(value_kind == "STRING", _quoted(value)).otherwise(bare)
        )

    whole = F.to_json(F.map_filter(entries, lambda key, _: ~key.isin(*ENVELOPE_KEYS)))
    rebuilt = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(names), member), ","), F.lit("}"))
    return F.when(spelled.isNull(), whole).otherwise(rebuilt)


def truthy(document: Column, name: str) -> Column:
    """Truth value of a field. Absent, null, false, 0, "", [], {} are false; any other value is true."""
    value = field(document, name)
    value_kind = F.coalesce(kind(value), F.lit("VOID"))
    path = f"$.{name}"
    return (
        F.when(value_kind == "VOID", F.lit(False))
        .when(value_kind == "BOOLEAN", F.try_variant_get(document, path, "boolean"))
        .when(value_kind == "STRING", F.try_variant_get(document, path, "string") != "")
        .when(value_kind.startswith("ARRAY"), F.size(F.try_variant_get(document, path, "array<variant>")) > 0)
        .when(value_kind.startswith("OBJECT"), value_kind != "OBJECT<>")
        .otherwise(F.try_variant_get(document, path, "double") != 0.0)
    )


def float_or_default(document: Column, name: str, default: float) -> Column:
    """Numeric value of a field; ``default`` when absent, NULL when it is not a finite number.

    Booleans count as 0 and 1 and numeric strings are read, so that a sensor which quotes its numbers
    still works.
    """
    value = field(document, name)
    value_kind = kind(value)
    path = f"$.{name}"
    text = F.trim(F.regexp_replace(F.try_variant_get(document, path, "string"), r"^\s+|\s+$", ""))
    from_text = F.when(text.rlike(_FLOAT_TEXT), F.regexp_replace(text, "_", "").try_cast("double"))
    number = (
        F.when(value_kind == "STRING", from_text)
        .when(value_kind == "BOOLEAN", F.try_variant_get(document, path, "boolean").cast("int").cast("double"))
        .when(
            (value_kind == "BIGINT") | (value_kind == "DOUBLE") | value_kind.startswith("DECIMAL"),
            F.try_variant_get(document, path, "double"),
        )
    )
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    return F.when(value_kind.isNull(), F.lit(float(default))).otherwise(finite)
