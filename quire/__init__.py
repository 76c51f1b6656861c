"""quire: a Spark-native engine for preparing and measuring text corpora for
masked-language-model pre-training.

Every operator is a DataFrame transformation; Python crosses the JVM boundary
only for model inference, user tokenizers and ordered packing's per-block
pointer walks (Arrow-batched ``applyInPandas``).
"""

from quire.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
__version__ = "0.1.0"
