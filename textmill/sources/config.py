"""Settings: defaults, checks, and the YAML form."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace
from urllib.parse import urlsplit

from textmill.functions.urls import host_to_dir

STRATEGIES, EMBEDDERS = ("heading", "fixed"), ("auto", "tfidf", "ollama", "openai", "cohere")


@dataclass(frozen=True)
class Config:
    seed_url: str = ""
    output_dir: str = "./docs-output"
    rate_limit: float = 0.0
    workers: int = 10
    max_depth: int = 0
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    use_browser: bool = False
    user_agent: str = "textmill/1.0"
    timeout_s: float = 30.0
    resume: bool = False
    verbose: bool = False
    chunk_strategy: str = "heading"
    max_tokens: int = 512
    overlap_tokens: int = 50
    embedder: str = "auto"
    embedding_model: str = "nomic-embed-text"
    embedding_batch: int = 64

    def with_(self, **changes: object) -> Config:
        return replace(self, **changes)

    def validate(self) -> Config:
        """Raises ValueError with all that is wrong, one line each."""
        url = urlsplit(self.seed_url)
        wrong = [
            text
            for bad, text in (
                (not self.seed_url, "seed URL is empty"),
                (bool(self.seed_url) and not (url.scheme and (url.netloc or url.path.startswith("/"))) and not self.seed_url.startswith("/"), f"seed URL isn't absolute: {self.seed_url}"),
                (self.workers <= 0, "workers must be positive"),
                (self.rate_limit < 0, "rate limit must not be negative"),
                (self.timeout_s <= 0, "timeout must be positive"),
                (not self.output_dir, "output folder is empty"),
                (self.max_tokens <= 0, "max tokens must be positive"),
                (self.chunk_strategy not in STRATEGIES, f"unknown chunk strategy: {self.chunk_strategy}"),
                (self.embedder not in EMBEDDERS, f"unknown embedder: {self.embedder}"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("\n".join(wrong))
        return self


#: Where the YAML form has each setting; second names are accepted as well.
SECTIONS = {
    "source": {"url": "seed_url"},
    "crawl": {
        "max_depth": "max_depth", "workers": "workers", "rate_limit": "rate_limit", "includes": "includes", "excludes": "excludes", "use_browser": "use_browser",
        "user_agent": "user_agent", "timeout_sec": "timeout_s", "resume": "resume", "include": "includes", "exclude": "excludes", "timeout": "timeout_s",
    },
    "chunking": {"strategy": "chunk_strategy", "max_tokens": "max_tokens", "overlap_tokens": "overlap_tokens"},
    "embedding": {"embedder": "embedder", "model": "embedding_model", "batch": "embedding_batch", "provider": "embedder", "batch_size": "embedding_batch"},
    "output": {"dir": "output_dir", "verbose": "verbose"},
}


def load_yaml(text: str, given: Config = Config(), **flags: object) -> Config:
    """Settings of a YAML text over `given`; zero values change nothing, `flags` win, unknown keys are passed over with a warning."""
    import yaml

    found: dict[str, object] = {}
    for section, keys in (yaml.safe_load(text) or {}).items():
        if section not in SECTIONS or not isinstance(keys, dict | None):
            warnings.warn(f"unknown section: {section}", stacklevel=2)
            continue
        for key, value in (keys or {}).items():
            name = SECTIONS[section].get(key)
            if name is None:
                warnings.warn(f"unknown key: {section}.{key}", stacklevel=2)
            elif value:
                found[name] = tuple(map(str, value)) if isinstance(value, list) else _seconds(value) if name == "timeout_s" else value
    known = {f.name for f in fields(Config)}
    return replace(given, **found | {k: v for k, v in flags.items() if k in known})


def _seconds(value: object) -> float:
    text = str(value)
    for unit, factor in (("ms", 0.001), ("s", 1.0), ("m", 60.0), ("h", 3600.0)):
        if text.endswith(unit) and text[: -len(unit)].replace(".", "", 1).isdigit():
            return float(text[: -len(unit)]) * factor
    return float(text)


def template(url: str) -> str:
    """A YAML text to start from: every key with its default, those that are rarely set as comments."""
    d = Config()
    return f"""source:
  url: {url}
crawl:
  max_depth: 3
  workers: {d.workers}
  # rate_limit: 2.0        # requests a second; without it, what the site's headers or robots.txt say
  # includes: ["/docs/**"]
  excludes:
    - "**/changelog/**"
  # user_agent: {d.user_agent}
  # timeout_sec: {d.timeout_s:g}
  # resume: true
chunking:
  strategy: {d.chunk_strategy}
  max_tokens: {d.max_tokens}
embedding:
  embedder: {d.embedder}
  # model: {d.embedding_model}
  # batch: {d.embedding_batch}
output:
  dir: ./{host_to_dir(urlsplit(url).hostname or "site")}-docs
"""
