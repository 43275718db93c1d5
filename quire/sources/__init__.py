from .tables import session, table

__all__ = ["session", "table"]
