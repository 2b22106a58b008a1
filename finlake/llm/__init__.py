"""Training-data operators: packing, chat formatting, secret scans, repeated
text, quality, language and decontamination.  Nothing else in the library
imports this subpackage."""
