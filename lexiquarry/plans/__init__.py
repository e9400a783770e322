"""Query language: parsing and compilation into DataFrame plans."""
