"""Engine options from ``key = value`` text: comments, size suffixes, unknown keys ignored."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass
class Config:
    vector_similarity_threshold: float = 0.5
    clustering_max_iterations: int = 100
    graph_max_traversal_depth: int = 10
    graph_max_neighbors_per_node: int = 0
    metrics_rate_tracker_window_size: int = 60
    cache_stats_alpha: float = 0.1
    health_memory_warning_bytes: int = 1 << 30
    health_memory_critical_bytes: int = 2 << 30
    health_error_rate_warning: float = 1.0
    health_error_rate_critical: float = 5.0
    log_compaction_keep_recent: int = 100_000
    snapshot_auto_interval: int = 50_000
    snapshot_cleanup_keep_count: int = 10
    replication_factor: int = 3
    min_quorum: int = 2


def parse_size(text: str) -> int:
    """A whole number with an optional suffix KB, MB or GB."""
    t = text.strip().upper()
    for suffix, shift in (("KB", 10), ("MB", 20), ("GB", 30)):
        if t.endswith(suffix):
            return int(t[:-2].strip()) << shift
    return int(t)


def parse(text: str) -> Config:
    config, kinds = Config(), {f.name: f.type for f in fields(Config)}
    for line in text.splitlines():
        key, sep, value = line.split("#", 1)[0].partition("=")
        key, value = key.strip(), value.strip().strip('"')
        if sep and key in kinds:
            setattr(config, key, float(value) if kinds[key] == "float" else parse_size(value))
    return config
