"""Names, orders and options that all operators share."""

from __future__ import annotations

from dataclasses import dataclass, field

# Enumerations; an entry's place is its ordinal, which sorts depend on.
LINK_TYPES = ("relative-link", "wikilink", "anchor", "image-embed", "transclusion", "frontmatter-related", "external")
NAVIGATIONAL = LINK_TYPES[:6]
HEALTH = ("unresolved", "valid", "broken", "broken-anchor", "non-note", "ambiguous", "external", "ignored")
TARGET_KINDS = ("none", "document", "section", "asset", "external", "directory")
POLICIES = ("exact", "longest-suffix", "basename")
SEVERITIES = ("info", "warning", "error")
FINDING_KINDS = (
    "broken-link", "broken-anchor", "orphan", "unreachable", "ambiguous", "knowledge-gap", "under-linked", "dead-end", "suggested-link", "dead-link",
    "articulation-point", "bridge", "low-scent-anchor", "far-from-root", "okf-missing-frontmatter", "okf-missing-type", "okf-reserved-file-structure",
)
BOWTIE = ("disconnected", "core", "in", "out", "tendril")
NOTICE_KINDS = ("skipped-symlink", "skipped-oversize", "truncated", "nested-repository", "ignore-file", "git-ignore", "config", "parse", "analysis")

INDEX_NAMES = ("readme.md", "index.md")
ROOT_NAMES = ("readme.md", "index.md", "skill.md")


def finding_kind(name: str) -> int:
    """Ordinal of a finding kind; a usage error for anything else."""
    if name not in FINDING_KINDS:
        raise ValueError(f"no finding kind {name!r}; one of {', '.join(FINDING_KINDS)}")
    return FINDING_KINDS.index(name)


@dataclass(frozen=True)
class Config:
    """Options of one analysis; the defaults are the reference behaviour."""

    roots: tuple[str, ...] = ()
    content_roots: tuple[str, ...] = ()
    inbound_threshold: int = 3
    structure_severity: str = "info"
    min_shared: int = 2
    far_threshold: int = 6
    emit_exclude: tuple[str, ...] = ()
    okf: bool = False
    respect_gitignore: bool = False
    policy: str = "longest-suffix"
    strict: bool = False
    ignore: tuple[str, ...] = ()
    directive: str = "inkgraph"
    max_file_bytes: int = 10 << 20
    max_files: int = 10_000
    output_dir: str | None = None
    nav_types: tuple[str, ...] = field(default=NAVIGATIONAL)

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"no resolution policy {self.policy!r}")
        if self.structure_severity not in ("info", "warning"):
            raise ValueError(f"structure findings are info or warning, not {self.structure_severity!r}")
