from tabulyst.streaming.batches import foreach_batch_tables

__all__ = ["foreach_batch_tables"]
