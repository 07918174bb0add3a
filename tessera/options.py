"""Run options and the fixed values the translation rules depend on."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. These must stay equal to the behaviour being reproduced, so
# they are written out plainly, in natural order, in one place.
# ---------------------------------------------------------------------------

# Tag names treated as inline; every other element is a block.
INLINE_TAGS = (
    "a", "abbr", "acronym", "b", "bdo", "big", "br", "button", "cite", "code",
    "dfn", "em", "i", "img", "input", "kbd", "label", "map", "object",
    "output", "q", "samp", "script", "select", "small", "span", "strong",
    "sub", "sup", "textarea", "time", "tt", "var",
)

# Elements whose whole subtree is left out of grouping.
SKIPPED_TAGS = ("script",)

# Characters that make a text node ignorable when it holds nothing else.
IGNORABLE_CHARS = "\n\u00a0"

# Characters removed before two texts are compared; the rest is lower-cased.
COMPACT_CHARS = " \n\t,，."

# Model name to vocabulary name, with the fallback for unknown models.
ENCODING_MAP = (
    ("gpt-4-0613", "cl100k_base"),
    ("gpt-4-1106-preview", "cl100k_base"),
    ("gpt-3.5-turbo", "cl100k_base"),
    ("text-embedding-ada-002", "cl100k_base"),
    ("text-davinci-002", "p50k_base"),
    ("text-davinci-003", "p50k_base"),
    ("davinci", "p50k_base"),
)
DEFAULT_ENCODING = "cl100k_base"

# Void elements of the HTML tree builder: they never hold children.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid",
    "spacer",
)

# Elements inside which whitespace-only text is kept as is.
PRESERVE_WHITESPACE_TAGS = ("pre", "textarea")

# Elements whose text is written back without entity escaping.
RAW_TEXT_TAGS = ("script", "style")

# Default token rule: a word run, or any single non-space symbol.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\x0B]"


@dataclass(frozen=True)
class Options:
    """Settings of one translation run (defaults equal the reproduced behaviour)."""

    source_language: str = "English"
    target_language: str = "Simplified Chinese"
    translate_model: str = "gpt-4-1106-preview"
    fit_model: str = "gpt-4-1106-preview"
    default_model: str = "gpt-4-1106-preview"
    default_system_prompt: str = "you are a helpful assistant."
    # int(4096 * 0.4)
    max_tokens: int = 1638
    translate_temperature: float = 0.01
    fit_temperature: float = 0.01
    fit_temperature_growth: float = 1.6
    # attempts = max_fit_retry + 1
    max_fit_retry: int = 10
    # rate limit: at most `rate_limit` calls per `rate_period_sec`
    rate_limit: int = 1
    rate_period_sec: float = 3.5
    call_max_retry: int = 10
    backoff_init_delay: float = 1.0
    backoff_exp_base: float = 2.0
    backoff_cap_sec: float = 300.0
    # the factor of each further error is backoff_exp_base plus or minus up to this
    backoff_jitter: float = 1.0
    # calls that share one back-off state: those of one model (or of one request_id)
    backoff_key: str = "model"
    # failed calls due within so many seconds of the first are asked in one round
    retry_gather_sec: float = 5.0
    # a task stores the replies it has every so many seconds
    store_sec: float = 10.0
    # "fail_page": an unreadable or failed segment loses its page (parity);
    # "keep": only the groups of that segment are marked as errors.
    on_segment_error: str = "fail_page"
    # number of lanes (tasks) of the model-call stage; None: the cores of the session.
    # More lanes than cores keep the limit too, but use only part of it
    call_partitions: int | None = None
    # calls of one task that run at the same time (their opening is paced)
    calls_in_flight: int = 8
    # first calls are made and stored in so many waves
    call_waves: int = 4
    # spread pages round-robin over so many partitions before tokenizing
    # (None: the partitions of the input)
    page_partitions: int | None = None

    def with_(self, **kw) -> "Options":
        return replace(self, **kw)

    @property
    def fit_attempts(self) -> int:
        return self.max_fit_retry + 1
