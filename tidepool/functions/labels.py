"""What a text is about, told by its words: scope, fit to a review's policy class, and domains of authority. Each label is one alternation of its phrases, so a text is
read once a label, in the JVM; there is no loop over phrases and no join."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions import text as tx

# Phrases anywhere in the lower-case text; the first scope that has one is the text's.
SCOPES = [
    ("production", ["production", "prod "]),
    ("staging", ["staging"]),
    ("lab", [" lab", "lab "]),
    ("maintenance", ["maintenance", "reset window", "maintenance window", "rebuild window"]),
    ("production", ["breakglass", "outage", "emergency", "restore", "recovery"]),
    ("migration", ["migration", "cutover", "temporary", "bridge"]),
]
# The scopes of a query that a review's scope fits.
FITTING = {"production": ["production"], "staging": ["staging", "lab"], "lab": ["lab", "staging"], "migration": ["migration"], "maintenance": ["maintenance"]}
# Phrases of a query that a review's policy class fits; a class that is not listed fits every query.
POLICY_CLASSES = {
    "network-exposure-exception": ["host", "bind", "listen", "service", "port", "0.0.0.0", "localhost"],
    "destructive-maintenance": ["delete", "drop", "reset", "rebuild", "prune", "cleanup", "rollback", "remove"],
    "secret-handling-exception": ["token", "password", "secret", "credential", "vault", "env"],
    "migration-exception": ["migration", "cutover", "bridge", "temporary"],
    "breakglass-exception": ["breakglass", "outage", "emergency", "temporary recovery", "temporary procedure", "restore"],
    "private-infrastructure-exception": ["relay", "internal host", "endpoint", "subnet", "cidr", "share path", "unc path", "internal path", "tunnel"],
    "auth-bypass-exception": ["without auth", "no auth", "disable auth", "skip auth", "bypass auth", "packet capture"],
    "data-reset-exception": ["drop", "reset", "wipe", "rebuild from scratch", "truncate", "erase"],
    "traffic-cutover-exception": ["cutover", "switch traffic", "redirect traffic", "promote", "swap endpoint", "new relay"],
}
# Words (whole ones) and phrases of each domain, in the order in which domains are named.
DOMAINS = {
    "security": ["token", "credential", "secret", "api key", "private key", "certificate", "authentication", "authorization", "without auth", "bypass auth", "disable auth", "auth token"],
    "networking": ["network", "subnet", "private endpoint", "internal hostname", "internal share path", "share path", "relay endpoint", "hostname", "host name", "dns", "port", "tunnel", "bridge"],
    "maintenance": ["maintenance", "breakglass", "recovery", "outage", "cutover", "reset window", "maintenance reset", "failover"],
    "build-toolchain": ["build", "compile", "toolchain", "msvc", "cargo", "rustc", "cuda toolkit", "nvcc", "linker"],
    "runtime-ops": ["runtime", "run on", "runs on", "gpu host", "cuda device", "embedding service", "rerank service", "native windows", "wsl host", "where should"],
    "deployment": ["startup", "scheduled task", "systemd", "autostart", "launch at logon", "logon", "startup path", "boot path", "service host path"],
}


def any_of(phrases: list[str]) -> str:
    """A pattern that finds any of the phrases."""
    return "|".join(re.escape(p).replace("\\ ", " ") for p in phrases)


def words_or_phrases(phrases: list[str]) -> str:
    """A pattern for normalised texts: single words only as whole words."""
    single, several = [p for p in phrases if " " not in p], [p for p in phrases if " " in p]
    return "|".join([f"(^| )({any_of(single)})( |$)", *several])


def scope(text: Column) -> Column:
    """production, staging, lab, maintenance, migration or general."""
    low, out = F.lower(text), F.lit("general")
    for name, phrases in reversed(SCOPES):
        out = F.when(low.rlike(any_of(phrases)), name).otherwise(out)
    return out


def scope_fits(own: Column, asked: Column) -> Column:
    """Whether a review's scope fits a query's; none, general and unknown ones fit all."""
    out = F.lit(True)
    for name, fitting in FITTING.items():
        out = F.when(own == name, asked.isin(fitting)).otherwise(out)
    return out


def class_fits(own: Column, query: Column) -> Column:
    """Whether a review's policy class fits what a query says."""
    low, out = F.lower(query), F.lit(True)
    for name, phrases in POLICY_CLASSES.items():
        out = F.when(own == name, low.rlike(any_of(phrases))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def domains(text: Column) -> Column:
    """The domains whose words or phrases a text has, in order; none for a null text."""
    plain = tx.normalize(text)
    return F.array_compact(F.array(*[F.when(plain.rlike(words_or_phrases(phrases)), name) for name, phrases in DOMAINS.items()]))
