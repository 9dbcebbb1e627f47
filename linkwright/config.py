"""Settings of the linkage pipeline."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Settings:
    """One immutable set of parameters; `fingerprint` names the cached tables built with it."""

    # Results depend on them.
    seed: int = 42
    max_posting: int = 180
    max_candidates: int = 80
    negatives_per_entity: int = 6
    val_fraction: float = 0.20
    thresholds: tuple[float, ...] = tuple(round(0.30 + 0.05 * i, 2) for i in range(14))
    default_threshold: float = 0.50
    tfidf_min_df: int = 3
    tfidf_max_terms: int = 200_000
    tfidf_ngrams: tuple[int, int] = (2, 4)
    # Gradient boosted trees: 63 leaves as depth 6, 40 rows to a leaf, step 0.05, share of columns 0.8.
    boosting: dict = field(default_factory=lambda: {"maxIter": 250, "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 40, "featureSubsetStrategy": "0.8", "subsamplingRate": 1.0})

    def fingerprint(self) -> str:
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


DEFAULT = Settings()
PREFIX = {"source1": "S1-", "source2": "S2-", "source3": "S3-"}
SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")
LABEL_COLUMNS = ("source1_entity_id", "matched_entity_ids")
