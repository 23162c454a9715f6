from .columns import (count_if, display_date, display_time, due_date_of, full_address, or_default, percent_text, period_of,
                      value_rank)

__all__ = ["count_if", "display_date", "display_time", "due_date_of", "full_address", "or_default", "percent_text", "period_of",
           "value_rank"]
