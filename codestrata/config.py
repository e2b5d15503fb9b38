"""Settings: defaults, a file's values over them, and environment variables over both."""

from __future__ import annotations

from collections.abc import Mapping

PREFIX = "CODESTRATA_"


def _typed(text: str, like: object) -> object:
    """A variable's text as the type of the value it replaces."""
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    for kind in (int, float):
        if isinstance(like, kind):
            try:
                return kind(text)
            except ValueError:
                return like
    if isinstance(like, list):
        return [x.strip() for x in text.split(",") if x.strip()]
    return text


def merged(base: Mapping, over: Mapping) -> dict:
    """``over`` laid on ``base``, nested parts member by member."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(out.get(key), Mapping) and isinstance(value, Mapping) else value
    return out


def with_environment(settings: Mapping, environ: Mapping[str, str], path: str = PREFIX) -> dict:
    """Settings with the variables that name them: ``PREFIX`` and the members' names in upper case, joined by ``_``."""
    out = {}
    for key, value in settings.items():
        name = f"{path}{key.upper()}"
        if isinstance(value, Mapping):
            out[key] = with_environment(value, environ, f"{name}_")
        else:
            out[key] = _typed(environ[name], value) if name in environ else value
    return out


def flat(settings: Mapping, path: str = "") -> dict[str, str]:
    """Dotted names and texts of all settings."""
    out = {}
    for key, value in settings.items():
        if isinstance(value, Mapping):
            out.update(flat(value, f"{path}{key}."))
        else:
            out[f"{path}{key}"] = ",".join(map(str, value)) if isinstance(value, list) else str(value).lower() if isinstance(value, bool) else str(value)
    return out
