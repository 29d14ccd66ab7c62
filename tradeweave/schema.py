"""Column layouts shared by every reader and operator."""

from __future__ import annotations

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(28,2)"

# Our columns and the headings of the CSV files a bank would hand over, in the files' order.
INDUSTRY_HEADINGS = {"sic_code": "sicCode", "name": "name", "sector": "sector"}
PRODUCT_HEADINGS = {"product_id": "productId", "name": "name", "pillar": "pillar", "monthly_fee": "monthlyFee"}
ENTITY_HEADINGS = {
    "entity_id": "customerId", "name": "name", "registration_number": "registrationNumber", "region": "region",
    "segment": "segment", "status": "status", "turnover": "turnover", "risk_score": "riskScore", "sic_code": "sicCode",
}
ACCOUNT_HEADINGS = {
    "account_id": "accountId", "entity_id": "customerId", "account_type": "accountType", "open_date": "openDate", "balance": "balance",
}
TRANSACTION_HEADINGS = {
    "transaction_id": "transactionId", "sender_account_id": "senderAccountId", "receiver_account_id": "receiverAccountId",
    "amount": "amount", "currency": "currency", "date": "date", "channel": "channel", "reference": "reference",
}
HOLDING_HEADINGS = {"entity_id": "customerId", "product_id": "productId", "since": "since"}
TRUTH_HEADINGS = {
    "banked_id": "bankedCustomerId", "unbanked_id": "unbankedEntityId", "banked_name": "bankedName", "unbanked_name": "unbankedVariantName",
}


def _as_text(headings: dict[str, str]) -> str:
    """Every field is read as text and converted with try_cast, so a malformed number becomes NULL, not an error."""
    return ", ".join(f"{heading} string" for heading in headings.values())


INDUSTRY_FILE = _as_text(INDUSTRY_HEADINGS)
PRODUCT_FILE = _as_text(PRODUCT_HEADINGS)
ENTITY_FILE = _as_text(ENTITY_HEADINGS)
ACCOUNT_FILE = _as_text(ACCOUNT_HEADINGS)
TRANSACTION_FILE = _as_text(TRANSACTION_HEADINGS)
HOLDING_FILE = _as_text(HOLDING_HEADINGS)
TRUTH_FILE = _as_text(TRUTH_HEADINGS)

ENTITY_COLUMNS = list(ENTITY_HEADINGS)
TRADE_COLUMNS = ["src", "dst", "amount", "tx_count", "avg_interval"]
MATCH_COLUMNS = [
    "banked_id",
    "unbanked_id",
    "confidence",
    "name_sim",
    "industry_sim",
    "region_sim",
    "trading_sim",
]
