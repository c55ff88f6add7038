"""Lenient coercions of loosely typed catalog values.

Raw rows arrive as VARIANT, so one value may be text, number, list or object.
The expressions below look at the stored kind and never fail on odd input.

They are put together as SQL text: ``*_sql`` functions take and return text, so
that nested lambdas stay short to build, and the plain names return Columns for
a column name or any other SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine import settings

# Blanks at either end, Unicode ones included.
ENDS = r"(?U)^\\s+|\\s+$"
# A number written with a Java type suffix is not a number in the catalog.
JAVA_SUFFIX = r"(?i)[0-9.][df]\\s*$"


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '{ENDS}', '')"


def field_sql(v: str, name: str) -> str:
    return f"try_variant_get({v}, '$.{name}', 'variant')"


def text_sql(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def list_sql(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def object_sql(v: str) -> str:
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def kind_sql(v: str) -> str:
    return f"schema_of_variant({v})"


def is_container_sql(v: str) -> str:
    return f"({kind_sql(v)} like 'ARRAY%' or {kind_sql(v)} like 'OBJECT%')"


def truthy_text_sql(v: str) -> str:
    """Text form of a value that counts as present, else NULL.

    Missing, null, empty text, zero, false and empty containers do not count.
    """
    t = text_sql(v)
    return (
        f"case when {kind_sql(v)} = 'STRING' then case when {t} <> '' then {t} end"
        f" when {kind_sql(v)} = 'VOID' then null"
        f" when {kind_sql(v)} = 'BOOLEAN' then case when {t} = 'true' then 'True' end"
        f" when {is_container_sql(v)} then case when {t} not in ('[]', '{{}}') then {t} end"
        f" when try_cast({t} as double) <> 0 then {t} end"
    )


def truthy_sql(v: str) -> str:
    return f"({truthy_text_sql(v)}) is not null"


def either_sql(a: str, b: str) -> str:
    return f"case when {truthy_sql(a)} then {a} else {b} end"


def display_text_sql(v: str) -> str:
    """Text form of one value, with None/True/False spelled as in Python."""
    return (
        f"case when {kind_sql(v)} = 'STRING' then {text_sql(v)}"
        f" when {v} is null or {kind_sql(v)} = 'VOID' then 'None'"
        f" when {kind_sql(v)} = 'BOOLEAN' then initcap({text_sql(v)})"
        f" else {text_sql(v)} end"
    )


def joined_parts_sql(parts: str, count: int = 3) -> str:
    """First ``count`` non-blank trimmed parts joined by a blank; may be empty text."""
    clean = f"filter(transform({parts}, p -> {strip_sql('p')}), p -> p <> '')"
    return f"array_join(slice({clean}, 1, {count}), ' ')"


def first_text_sql(v: str) -> str:
    shown = f"transform({list_sql(v)}, e -> {display_text_sql('e')})"
    # Plain text is by far the commonest and is tried first.
    text = (
        f"case when {kind_sql(v)} = 'STRING' then {strip_sql(text_sql(v))}"
        f" when {v} is null or {kind_sql(v)} = 'VOID' then null"
        f" when {kind_sql(v)} like 'ARRAY%' then {joined_parts_sql(shown)}"
        f" when {kind_sql(v)} like 'OBJECT%' then {joined_parts_sql(f'map_keys({object_sql(v)})')}"
        f" else {strip_sql(display_text_sql(v))} end"
    )
    return f"nullif({text}, '')"


def number_sql(t: str) -> str:
    return f"case when not {t} rlike '{JAVA_SUFFIX}' then try_cast({t} as double) end"


def float_sql(t: str) -> str:
    return number_sql(f"translate({t}, '$,', '')")


def int_sql(t: str) -> str:
    return f"try_cast({number_sql(f'''translate({t}, ',', '')''')} as bigint)"


def first_present_sql(values: str) -> str:
    return f"get(filter({values}, x -> x is not null), 0)"


def image_value_sql(item: str, key: str) -> str:
    """Text under ``key`` of an object; of a list there, the first item that counts."""
    value = field_sql(item, key)
    listed = first_present_sql(f"transform({list_sql(value)}, u -> {truthy_text_sql('u')})")
    return (
        f"case when {kind_sql(value)} like 'ARRAY%' then {listed}"
        f" else {truthy_text_sql(value)} end"
    )


def object_in_list_sql(items: str) -> str:
    """Best url of the objects in a list; each key is tried on every item before the next key."""
    per_key = [
        first_present_sql(f"transform({items}, o -> {image_value_sql('o', key)})")
        for key in settings.IMAGE_KEYS
    ]
    return f"coalesce({', '.join(per_key)})"


def nested_image_sql(v: str) -> str:
    """Url in a list that holds lists, to any depth, the first in reading order.

    A stack of values still to be looked at: text is the answer, a list is
    answered by its own objects or else gives way to its items. No value opens
    without a bracket or a comma, which bounds the steps.
    """
    steps = f"sequence(1, regexp_count({text_sql(v)}, '[\\\\[,]') + 2)"
    head = "get(s.stack, 0)"
    rest = "slice(s.stack, 2, size(s.stack))"
    items = list_sql(head)
    state = "named_struct('found', {found}, 'stack', {stack})".format
    in_list = state(found=object_in_list_sql(items), stack=f"concat({items}, {rest})")
    in_text = state(found=truthy_text_sql(head), stack=rest)
    step = (
        f"case when s.found is not null or size(s.stack) = 0 then s"
        f" when {items} is not null then {in_list}"
        f" when {kind_sql(head)} = 'STRING' then {in_text}"
        f" else {state(found='s.found', stack=rest)} end"
    )
    start = state(found="cast(null as string)", stack=f"array({v})")
    return f"aggregate({steps}, {start}, (s, n) -> {step}, s -> s.found)"


def image_url_sql(v: str) -> str:
    """Best image url in text, an object, or a list of either, nested to any depth."""
    items = list_sql(v)
    text = f"case when {kind_sql('t')} = 'STRING' then {truthy_text_sql('t')} end"
    in_flat = f"coalesce({object_in_list_sql(items)}, {first_present_sql(f'transform({items}, t -> {text})')})"
    in_object = f"coalesce({', '.join(image_value_sql(v, key) for key in settings.IMAGE_KEYS)})"
    return (
        f"case when exists({items}, l -> {kind_sql('l')} like 'ARRAY%') then {nested_image_sql(v)}"
        f" when {items} is not null then {in_flat}"
        f" when {kind_sql(v)} = 'STRING' then {truthy_text_sql(v)}"
        f" when {kind_sql(v)} like 'OBJECT%' then {in_object} end"
    )


def lenient_int_sql(v: str, default: int = 0) -> str:
    """Whole number of a stored value: numbers truncate, text must be whole."""
    t = text_sql(v)
    whole = rf"case when {t} rlike '^\\s*[+-]?\\d+\\s*$' then try_cast({t} as bigint) end"
    return (
        f"coalesce(case when {v} is null or {kind_sql(v)} in ('VOID', 'BOOLEAN') then null"
        f" when {kind_sql(v)} = 'STRING' then {whole}"
        f" when {is_container_sql(v)} then null"
        f" when {kind_sql(v)} = 'BIGINT' then try_cast({t} as bigint)"
        f" else try_cast(try_cast({t} as double) as bigint) end, cast({default} as bigint))"
    )


def lenient_float_sql(v: str, default: float = 0.0) -> str:
    return (
        f"coalesce(case when {v} is null or {kind_sql(v)} in ('VOID', 'BOOLEAN') then null"
        f" when {is_container_sql(v)} then null"
        f" else {number_sql(text_sql(v))} end, cast({default} as double))"
    )


def text_items_sql(v: str) -> str:
    """Only the text items of a list; an empty list for anything else."""
    texts = f"filter({list_sql(v)}, e -> {kind_sql('e')} = 'STRING')"
    return f"coalesce(transform({texts}, e -> {text_sql('e')}), cast(array() as array<string>))"


def field(v: str, name: str) -> Column:
    return F.expr(field_sql(v, name))


def either(a: str, b: str) -> Column:
    """``a`` when it counts as present, else ``b``."""
    return F.expr(either_sql(a, b))


def truthy(v: str) -> Column:
    return F.expr(truthy_sql(v))


def first_text(v: str) -> Column:
    """Trimmed text; of a list its first three non-blank items joined; else NULL."""
    return F.expr(first_text_sql(v))


def coerce_float(v: str) -> Column:
    """Number of a value with currency sign and thousands separators, else NULL."""
    return F.expr(float_sql(text_sql(v)))


def coerce_int(v: str) -> Column:
    """Whole number, cut towards zero, of a value with separators, else NULL."""
    return F.expr(int_sql(text_sql(v)))


def pick_image_url(v: str) -> Column:
    return F.expr(image_url_sql(v))


def lenient_int(v: str, default: int = 0) -> Column:
    return F.expr(lenient_int_sql(v, default))


def lenient_float(v: str, default: float = 0.0) -> Column:
    return F.expr(lenient_float_sql(v, default))


def text_items(v: str) -> Column:
    return F.expr(text_items_sql(v))


def float_from_text(t: str) -> Column:
    return F.expr(float_sql(t))


def int_from_text(t: str) -> Column:
    return F.expr(int_sql(t))


def rating_number(t: str) -> Column:
    """Finite number in a text attribute, 0 otherwise."""
    n = f"({number_sql(t)})"
    return F.expr(
        f"coalesce(case when not isnan({n}) and abs({n}) <> double('Infinity') then {n} end, 0D)"
    )
