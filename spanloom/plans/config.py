"""Settings of the insertion pipeline."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    max_clipped_pos_dist: int = 5
    min_insertion_size: int = 50
    max_trans_size: int = 10_000
    min_stable_mapq: int = 20
    min_clip_len: int = 15
    max_seq_error: float = 0.04
    seed: int = 0
    per_contig_stats: bool = False
    read_len: int = 150
    max_is: int = 1000
    clip_penalty: int = 7
    max_mh_len: int = 100

    @classmethod
    def parse(cls, text: str) -> Config:
        """From lines of a key and a value; the last of equal keys wins, unknown keys are left out."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        given = dict(line.split(None, 1) for line in text.splitlines() if len(line.split(None, 1)) == 2)
        cast = lambda kind, v: v.strip() not in ("0", "false", "False") if kind is bool else kind(v)
        return cls(**{k: cast(kinds[k], v) for k, v in given.items() if k in kinds})
