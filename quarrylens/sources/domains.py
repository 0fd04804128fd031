"""Domain packs: the terms that make the side-program rule look, from an installed module, a file or a folder of packs."""

from __future__ import annotations

import importlib
import runpy
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class DomainRules:
    domain_id: str = "core-only"
    side_program_terms: tuple[str, ...] = ()
    authority_terms: tuple[str, ...] = ()
    excluded_files: tuple[str, ...] = ()
    excluded_prefixes: tuple[str, ...] = ()


def _rules(symbols: dict, domain: str) -> DomainRules | None:
    found = symbols.get(f"{domain.upper()}_DOMAIN_RULES")
    if found is None or not hasattr(found, "domain_id"):
        return None
    return DomainRules(found.domain_id, *(tuple(getattr(found, f.name, ())) for f in fields(DomainRules)[1:]))


def load_domain(domain: str | None, file: str | None = None, folder: str | None = None, package: str | None = None) -> DomainRules:
    """Rules of a domain: those of file if it is given, else of a module of package, else of folder; no domain has no terms."""
    if not domain or domain == "core-only":
        return DomainRules()
    name = f"{domain}_domain_rules"
    if file is None and package is not None:
        try:
            module = importlib.import_module(f"{package}.{domain}.{name}")
        except ModuleNotFoundError as e:
            if not f"{package}.{domain}.{name}".startswith(e.name or "\0"):
                raise
        else:
            if (rules := _rules(vars(module), domain)) is not None:
                return rules
    at = Path(file) if file else Path(folder or ".") / domain / "python" / f"{name}.py"
    rules = _rules(runpy.run_path(str(at)), domain) if at.is_file() else None
    if rules is None:
        raise ValueError(f"no rules of domain {domain}" + (f" in {file}" if file else ""))
    return rules
