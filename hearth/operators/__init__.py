from . import billing, changes, integrity, reports

__all__ = ["billing", "changes", "integrity", "reports"]
