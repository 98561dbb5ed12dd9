"""Fixed values of the chain programs the decode jobs understand."""

from __future__ import annotations

from dataclasses import dataclass

# Programs.
CUSTODY_PROGRAM = "6AzuBKDsR88vinh399HV5v7fgB1eZyoYwQ3PmdYqFRZG"
SYSTEM_PROGRAM = "11111111111111111111111111111111"
TOKEN_PROGRAMS = ["TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb"]

# Custody instruction prefixes as hex, and the argument that names the wallet.
LOCK_PREFIX = "5de284a68d093065"
UNLOCK_PREFIX = "8eb5bf9552afd864"
RESTART_PREFIX = "042211a8aa29e88801"
CUSTODY_WALLET_ARGUMENT = 4

# First byte of the burn instructions and the argument that names the asset.
BURN_BYTES = ["08", "0F"]
BURN_ASSET_ARGUMENT = 2

# System transfer code, amount offset, recipient argument and royalty recipients.
TRANSFER_CODE = 2
TRANSFER_AMOUNT_AT = 5
TRANSFER_RECIPIENT_ARGUMENT = 2
ROYALTY_FIRST = "8VAHrpJ9nsqRLaujbzpuCxhAhjsE8wA4ZvUHwx2VZw3y"
ROYALTY_SECOND = "RRUMF9KYPcvNSmnicNMAFKx5wDYix3wjNa6bA7R6xqA"

# Custody authority of a marketplace; a transfer into it needs a sale.
MARKET_VAULT = "1BWutmTvYPwDtmw9abTkS4Ssr8no61spGAvW1X6NDix"

BASE_UNITS = 1_000_000_000


@dataclass(frozen=True)
class SaleLayout:
    """Where one marketplace keeps the parts of a sale; argument and byte positions start at 1.

    ``event_prefix`` is None when the buying instruction carries the price itself.
    """

    market: str
    detail: str
    method: str
    program: str
    buy_prefix: str
    event_prefix: str | None
    asset: int
    buyer: int
    seller: int
    price_at: int


# Marketplace layouts in order of priority.
SALE_LAYOUTS = [
    SaleLayout(
        "Magic Eden",
        "Magic Eden V2",
        "magic_eden_execute_sale_v2_price",
        "M2mx93ekt1fmXSVkTrUL9xVFHkmME8HTUi5Cyc5aF7K",
        "5bdc31dfcc8135c1",
        None,
        asset=5,
        buyer=1,
        seller=2,
        price_at=11,
    ),
    SaleLayout(
        "Tensor",
        "Tensor Marketplace",
        "tensor_tcomp_take_event_amount",
        "TCMPhJdwDryooaGtiocG1u3xcYbRpiJzb283XfCZsDp",
        "447f2b08d41ff972",
        "6aa20ae28444df15",
        asset=6,
        buyer=2,
        seller=7,
        price_at=78,
    ),
    SaleLayout(
        "Tensor",
        "Tensor AMM",
        "tensor_amm_buy_sell_event_current_price",
        "TAMM6ub33ij1mbetoMyVBLeKY5iP41i4UPUJQGkhfsg",
        "60001cbe316b53de",
        "1fa2e49e99a0c6b6",
        asset=15,
        buyer=2,
        seller=8,
        price_at=10,
    ),
]
