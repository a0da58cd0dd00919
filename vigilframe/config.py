"""Tunable settings, one frozen dataclass per pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AnalysisConfig:
    """Signals, scoring and alert damping."""

    window_seconds: int = 60
    bucket_seconds: int = 5
    history_buckets: int = 60
    max_window_events: int | None = None
    idle_eviction_buckets: int = 720
    learning_minutes: int = 10
    alpha: float = 0.5
    weight_rate: float = 1.0
    weight_surprisal: float = 0.8
    weight_entropy: float = 0.4
    rate_z_reference: float = 8.0
    surprisal_reference_bits: float = 12.0
    entropy_z_reference: float = 6.0
    info_threshold: float = 0.5
    warn_threshold: float = 0.6
    critical_threshold: float = 0.8
    exit_factor: float = 0.8
    cooldown_seconds: int = 300
    similarity_threshold: float = 0.7
    max_templates: int | None = None

    @property
    def bucket_us(self) -> int:
        return max(self.bucket_seconds, 1) * 1_000_000

    @property
    def window_us(self) -> int:
        return self.window_seconds * 1_000_000

    @property
    def learning_us(self) -> int:
        return self.learning_minutes * 60_000_000

    @property
    def cooldown_us(self) -> int:
        return self.cooldown_seconds * 1_000_000


@dataclass(frozen=True)
class BaselineConfig:
    """Time-of-week baselines and unit profiles."""

    half_life_hours: float = 168.0
    min_weight: float = 720.0
    profile_min_weight: float = 200.0
    profile_max_templates: int | None = None
    max_bins: int | None = None
    max_baselines: int = 20_000
    negligible_weight: float | None = None
    snapshot_minutes: int = 5
    tz: str = "UTC"

    def half_life_buckets(self, bucket_seconds: int) -> float:
        return max(max(self.half_life_hours, 0.0) * 3600.0 / max(bucket_seconds, 1), 1.0)


@dataclass(frozen=True)
class QuietRule:
    """Drop events whose message matches ``pattern`` (and whose unit equals ``unit``, if given)."""

    pattern: str
    unit: str | None = None


# Maintenance messages that are silenced unless configured otherwise.
DEFAULT_QUIET_RULES: tuple[QuietRule, ...] = (
    QuietRule(r"^run-timeshift-\d+-backup\.mount: Deactivated successfully\.$"),
    QuietRule(r"\bdpkg-db-backup\.service\b"),
    QuietRule(r"\blogrotate\.service\b"),
    QuietRule(r"\bman-db\.service\b"),
    QuietRule(
        r"^flatpak-system-helper\.service: (Deactivated successfully\.|Consumed [0-9.]+s CPU time\.)$"
    ),
    QuietRule(
        r"^\(root\) CMD \(cd / && run-parts --report /etc/cron\.(hourly|daily|weekly|monthly)\)$"
    ),
    QuietRule(r"^\(root\) LIST \(root\)$"),
)

# Name prefixes of desktop infrastructure hidden in service overviews.
DEFAULT_HIDE_PREFIXES: tuple[str, ...] = (
    "gvfs-",
    "xdg-",
    "evolution-",
    "dbus",
    "dconf",
    "gnome-",
    "gcr-",
    "gpg-agent",
    "dirmngr",
    "keyboxd",
    "flatpak-",
    "pk-",
    "speech-dispatcher",
    "obex",
)


@dataclass(frozen=True)
class ActionPolicy:
    """What may be done on request, and how often."""

    dry_run: bool = True
    allowed_kinds: tuple[str, ...] = ()
    allowed_units: tuple[str, ...] = ()
    max_actions: int = 3
    window_minutes: int = 10
    self_filter_seconds: int = 30
    max_grace_secs: int = 60
    min_block_secs: int = 60
    max_block_secs: int = 604_800
    own_pids: tuple[int, ...] = ()


@dataclass(frozen=True)
class GraphConfig:
    """Note scan and link graph."""

    extensions: tuple[str, ...] = ("md", "markdown")
    # Directory names that are never descended into.
    exclude_dirs: tuple[str, ...] = (
        ".git",
        "node_modules",
        "target",
        ".cache",
        ".trash",
        ".obsidian",
        "graphify-out",
    )
    skip_hidden: bool = True
    max_files: int | None = None
    max_file_bytes: int | None = None
    min_term_len: int = 4
    #: Words too general to connect two headings; an empty tuple keeps all.
    stop_words: tuple[str, ...] = (
        "again", "and", "are", "because", "but", "chapter", "contents", "each", "ever", "every", "for", "here", "how",
        "its", "just", "like", "many", "most", "much", "must", "other", "page", "said", "section", "should", "such",
        "text", "title", "under", "until", "very", "well", "were", "will", "would",
        "abschnitt", "aber", "also", "auch", "damit", "dann", "eine", "jede", "jeder", "kapitel", "nicht", "oder",
        "seite", "sind", "sowie", "thema", "titel", "wenn", "wird", "zwischen",
    )
    max_term_docs: int = 20
    min_shared_score: int = 2
    max_inferred_per_file: int = 5
    max_edges: int | None = None
    max_links_per_file: int | None = None
    max_terms_per_file: int | None = None
    max_candidate_edges_per_file: int | None = None
    max_candidate_edges: int | None = None
    min_stable_secs: int = 600
    max_due: int = 10
    max_overlay_nodes: int | None = None
    roots: tuple[str, ...] = field(default_factory=tuple)
