"""Search settings, from code, an INI file or the command line."""

from __future__ import annotations

import argparse
import configparser
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class SearchConfig:
    """Limits and strategies of a search.

    A window counts if it occurs at most `maximal_match` times in the database; a target is reported with more than
    `minimal_seed` seeds, and the report has `maximal_hits` + 1 rows a query at most.
    """

    kind: str = "structure"  # or "sequence"
    minimal_length: int = 10
    minimal_seed: int = 4
    maximal_match: int = 50
    maximal_hits: int = 10_000
    select: str = "sw"  # sw, score, blast, score_sw, blast_sw
    match: int = 3
    mismatch: int = -2
    percent: float | None = None  # seeds asked for as a share of the query's windows, where that is more than minimal_seed
    report: str | None = None  # where result lines go
    sources: dict[str, str] = field(default_factory=dict)


#: Fixed spellings of [common] type.
KINDS = {"aacid": "sequence", "salami": "structure"}


def read_config(path: str) -> SearchConfig:
    """Settings of an INI file with the sections common, sources and limits; keys that are absent keep their defaults."""
    parser = configparser.ConfigParser()
    with open(path) as lines:
        parser.read_file(lines)
    limits = {k: parser.getint("limits", k) for k in ("minimal_length", "minimal_seed", "maximal_match", "maximal_hits") if parser.has_option("limits", k)}
    kind = parser.get("common", "type", fallback="salami").strip("\"'")
    report = parser.get("result", "output", fallback=None)
    sources = {k: v.strip("\"'") for k, v in parser.items("sources")} if parser.has_section("sources") else {}
    return SearchConfig(kind=KINDS.get(kind, kind), report=report, sources=sources, **limits)


#: Fixed names and letters of the command line's options by the setting they give, besides those that name a source.
_OPTIONS = {"matchlen": ("-l", int, "minimal_length"), "minmatches": ("-m", int, "minimal_seed"), "maxresults": ("-n", int, "maximal_hits"), "match": ("-M", int, "match"), "mismatch": ("-D", int, "mismatch"), "percent": ("-p", float, "percent"), "reportfile": ("-r", str, "report")}
_SOURCES = {"query": "-q", "sequences": "-s", "alphabet": "-a", "subfile": "-x", "batchfile": "-b"}
_RANKINGS = {"allalign": ("-A", "sw"), "allscores": ("-S", "score"), "segmentscore": ("-B", "blast"), "scorefilter": ("-F", "score_sw"), "segfilter": ("-G", "blast_sw")}


def from_arguments(arguments: list[str]) -> SearchConfig:
    """Settings of the file that -c names, if any, and of the options, which go before it."""
    parser = argparse.ArgumentParser(description="Search sequences for shared words.")
    parser.add_argument("-c", dest="config", help="settings in INI form")
    for name, (short, kind, setting) in _OPTIONS.items():
        parser.add_argument(short, f"--{name}", dest=setting, type=kind)
    for name, short in _SOURCES.items():
        parser.add_argument(short, f"--{name}", dest=f"source {name}")
    for name, (short, ranking) in _RANKINGS.items():
        parser.add_argument(short, f"--{name}", dest="select", action="store_const", const=ranking, help=f"rank by {ranking}")
    given = {k: v for k, v in vars(parser.parse_args(arguments)).items() if v is not None}
    config = read_config(given.pop("config")) if "config" in given else SearchConfig()
    sources = {k.removeprefix("source "): given.pop(k) for k in list(given) if k.startswith("source ")}
    return replace(config, **given, sources=config.sources | sources)
