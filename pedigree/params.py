"""All tunable constants of the engine, passed to every builder."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: A parameter is a number, or the name of a column that holds it (for sweeps over a grid).
Parameter = int | float | str


@dataclass(frozen=True)
class Params:
    """Thresholds of the patterns, gates and evaluation."""

    min_history: Parameter = 8
    min_verified_versions: Parameter = 2
    churning_window: Parameter = 5
    solo_dominance: Parameter = 0.80
    overlap_window: Parameter = 3
    known_count: Parameter = 10
    min_baseline_streak: Parameter = 3
    high_prior_tenure: Parameter = 5
    exceptional_prior_tenure: Parameter = 20
    short_gap_ms: Parameter = 86_400_000
    release_age_hours: Parameter = 72
    fresh_dep_hours: Parameter = 24
    error_ttl_ms: Parameter = 300_000

    @classmethod
    def from_env(cls, prefix: str = "PEDIGREE_") -> Params:
        """Defaults overridden by environment variables such as PEDIGREE_KNOWN_COUNT; an unset or empty one leaves the default,
        one that is no positive number (of a whole-number parameter: no positive integer) is an error."""
        found = {}
        for field in fields(cls):
            name = prefix + field.name.upper()
            text = os.environ.get(name, "").strip()
            if not text:
                continue
            kind = type(field.default)
            try:
                value = float(text)
            except ValueError:
                value = 0.0
            if not 0 < value < float("inf") or (kind is int and value != int(value)):
                raise ValueError(f"{name} must be a positive {'number' if kind is float else 'integer'}, got {text}")
            found[field.name] = kind(value)
        return cls(**found)


# Mail domains and the publisher address of the CI bot.
FREE_WEBMAIL = ("gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com", "outlook.com", "live.com", "icloud.com", "me.com", "aol.com")
PRIVACY_PROVIDERS = ("protonmail.com", "protonmail.ch", "protonmail.me", "pm.me", "proton.me", "tutanota.com", "tutanota.de", "tuta.io", "guerrillamail.com")
MACHINE_EMAIL = "npm-oidc-no-reply@github.com"
