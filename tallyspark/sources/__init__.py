"""From raw releases (pages, chart CSV, sheet cells, topline text) to tidy tables."""
