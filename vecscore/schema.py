"""Record types and constants of the scoring engine."""

from __future__ import annotations

from dataclasses import dataclass, field

DIMENSIONS = 14

#: A transaction as it arrives. Unknown keys are ignored; last_transaction may be null.
PAYLOAD = """
id string,
transaction struct<amount: double, installments: int, requested_at: string>,
customer struct<avg_amount: double, tx_count_24h: int, known_merchants: array<string>>,
merchant struct<id: string, mcc: string, avg_amount: double>,
terminal struct<is_online: boolean, card_present: boolean, km_from_home: double>,
last_transaction struct<timestamp: string, km_from_current: double>
"""
LABELLED = "vector array<double>, label string"
EVALUATION = f"entries array<struct<request: struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in PAYLOAD.strip().split(chr(10)) for x in [x.rstrip(',')])}>, expected_approved: boolean>>"

# Quantisation and decision.
SCALE = 16_000
SENTINEL = -1.0
NEIGHBOURS = 5
THRESHOLD = 0.6
FRAUD_LABEL = "fraud"


# Normalisation constants and risk by merchant category.
@dataclass(frozen=True)
class Normalisation:
    max_amount: float = 10_000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1_440.0
    max_km: float = 1_000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10_000.0


@dataclass(frozen=True)
class Risk:
    default: float = 0.5
    by_mcc: dict = field(default_factory=lambda: {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50})
