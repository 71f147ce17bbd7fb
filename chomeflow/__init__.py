"""Japanese addresses in columns: canonical text, typed components, confidence, provenance and validation."""

from chomeflow.functions.codes import check_digit
from chomeflow.functions.text import kanji_number, sanitize
from chomeflow.operators.geocode import HttpResolver, Resolver, TableResolver, geocode
from chomeflow.plans.normalize import normalize, parse
from chomeflow.plans.validate import validate
from chomeflow.sources.registry import Registry, registry

__all__ = ["HttpResolver", "Registry", "Resolver", "TableResolver", "check_digit", "geocode", "kanji_number", "normalize", "parse", "registry", "sanitize", "validate"]
