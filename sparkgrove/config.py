"""Global settings and a context manager for them."""

from __future__ import annotations

from contextlib import contextmanager

_settings = {"verbosity": 1}


def set_config(**kw) -> None:
    unknown = set(kw) - set(_settings)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if not 0 <= kw.get("verbosity", 1) <= 3:
        raise ValueError("verbosity must be 0, 1, 2 or 3")
    _settings.update(kw)


def get_config() -> dict:
    return dict(_settings)


@contextmanager
def config_context(**kw):
    before = get_config()
    set_config(**kw)
    try:
        yield
    finally:
        _settings.update(before)
