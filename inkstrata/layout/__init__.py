"""OCR word tables to paragraphs, main text and footnotes."""
