"""Column expressions (JVM-side, codegen-friendly built-ins only)."""

from quire.functions.text import (  # noqa: F401
    WS_CLASS, clean_text, word_count, py_strip, na_to_null, code_text,
    combine_title_abstract, split_words,
)
from quire.functions.arrays import (  # noqa: F401
    label_rank, topk_hit, masked_lm_loss, pad_right, cosine,
)
from quire.functions.hashing import uniform  # noqa: F401
