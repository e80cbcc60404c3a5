"""Tables and file listings the operators read."""
from leafmill.sources.files import file_inventory
from leafmill.sources.tables import doc_pages, documents, pages, paginate, site_pages

__all__ = ["doc_pages", "documents", "file_inventory", "pages", "paginate", "site_pages"]
