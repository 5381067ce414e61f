from tidewatch.functions.nulls import (  # noqa: F401
    is_truthy,
    not_true,
    null_if_blank,
    quote_name,
    text_concat,
    unless_null,
)
