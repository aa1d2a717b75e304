"""quarrylight.sources"""
