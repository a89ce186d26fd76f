from .columns import (  # noqa: F401
    any_of,
    first_match,
    ladder,
    java,
    nonneg_double,
    nonneg_int,
    round2,
    round_half_even,
    safe_list,
    safe_text,
    squash,
    strip,
    words,
)
