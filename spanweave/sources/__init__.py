from .tables import as_intervals, event_intervals, order_intervals, table

__all__ = ["as_intervals", "event_intervals", "order_intervals", "table"]
