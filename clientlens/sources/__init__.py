from clientlens.sources.tables import Tables

__all__ = ["Tables"]
