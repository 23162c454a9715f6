from .payments import (PERIOD_PAYMENT_SCHEMA, apply_payment_stream, apply_payment_stream_by_period, ledger_path, post_by_period,
                       read_payment_stream)

__all__ = ["PERIOD_PAYMENT_SCHEMA", "apply_payment_stream", "apply_payment_stream_by_period", "ledger_path", "post_by_period",
           "read_payment_stream"]
