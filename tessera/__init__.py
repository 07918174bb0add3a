"""Spark-native translation of HTML page collections.

Main entry points::

    from tessera import Options, translate_pages, python_backend, replay_backend
"""

from tessera.operators.calls import RetryableError, python_backend, replay_backend
from tessera.options import Options
from tessera.plans.translation import Translation, translate_pages
from tessera.session import WorkArea
from tessera.sources.tree import translate_tree
from tessera.streaming.pages_stream import translate_stream

__all__ = [
    "Options",
    "RetryableError",
    "Translation",
    "WorkArea",
    "python_backend",
    "replay_backend",
    "translate_pages",
    "translate_stream",
    "translate_tree",
]
